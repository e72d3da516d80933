"""DuckDB SQL that gives the rows of this subpackage's queries where SQL can express them."""

from __future__ import annotations

#: ASCII capitals only; `lower` would change other letters as well
LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = "regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {}

SQL["op3_decontaminate"] = f"""
WITH item AS (SELECT item_id, {ALNUM_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {ALNUM_WORDS.format("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM doc, sizes)),
hit AS (SELECT doc_id, item_id, i, n FROM gram JOIN win USING (n, phrase)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
item_of AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN item_of USING (doc_id)
"""

_HIDDEN = r"<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_BLOCK = (r"</?(?:html|head|title|body|p|div|br|hr|li|ul|ol|dl|dt|dd|nav|h1|h2|h3|h4|h5|h6|article|section|aside|main"
          r"|header|footer|table|tr|td|th|pre|blockquote|form)\b[^>]*>")
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op5_line_dedup"] = rf"""
WITH page AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'gis'), '{_BLOCK}', chr(10), 'gi'), '<[^>]*>', '', 'g') AS text
  FROM pages),
total AS (SELECT coalesce(host, '') AS h, count(DISTINCT text) AS pages FROM page WHERE text IS NOT NULL GROUP BY 1),
line AS (
  SELECT coalesce(host, '') AS h, text, trim(unnest(list_distinct(string_split(text, chr(10)))), {_BLANK}) AS line FROM page),
common AS (
  SELECT h, line FROM line JOIN total USING (h) WHERE line <> '' GROUP BY h, line
  HAVING count(DISTINCT text) >= 3 AND count(DISTINCT text) > 0.1 * any_value(pages)),
drops AS (SELECT h, list(line) AS dropped FROM common GROUP BY 1),
split AS (SELECT page_id, host, coalesce(host, '') AS h, string_split(text, chr(10)) AS lines FROM page),
kept AS (
  SELECT page_id, host, lines,
    CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, trim(x, {_BLANK}))) END AS kept
  FROM split LEFT JOIN drops USING (h))
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM kept
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STEP = "CAST(floor(least(40, 40 * ({0}))) AS INT)"
_RULES = {
    "symbols": "n_symbols / greatest(1, word_chars)", "dup_lines": "n_dup_lines / greatest(1, n_lines)",
    "repeats": "n_repeat_words / greatest(1, n_words)", "long_words": "word_chars / (20 * greatest(1, n_words))"}
_STEPS_OF = ", ".join(f"{_STEP.format(v)} AS {k}" for k, v in _RULES.items())

SQL["op6_quality"] = rf"""
WITH word AS (SELECT doc_id, lang, text, {_WORDS} AS w FROM documents),
gram AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM word)),
again AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY 1),
line AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, {_BLANK}) <> '' GROUP BY 1),
stat AS (
  SELECT doc_id, coalesce(lang, 'none') AS stratum, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(coalesce(text, '')) - len(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(line.n - line.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(line.n, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM word LEFT JOIN line USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_STEPS_OF} FROM stat),
known AS (
  SELECT stratum, rule, step, quality FROM (
    SELECT stratum, quality, symbols, dup_lines, repeats, long_words FROM judged JOIN labels USING (doc_id)
    WHERE NOT base_failed AND quality IN (0, 1))
  UNPIVOT (step FOR rule IN (symbols, dup_lines, repeats, long_words))),
grid AS (SELECT stratum, rule, unnest(range(1, 41)) AS cut FROM (SELECT DISTINCT stratum, rule FROM known)),
rate AS (
  SELECT stratum, rule, cut, sum(quality) AS n, sum(1 - quality) AS m, sum(quality) FILTER (step >= cut) AS k0,
    sum(1 - quality) FILTER (step >= cut) AS b0 FROM grid JOIN known USING (stratum, rule) GROUP BY ALL),
term AS (
  SELECT stratum, rule, cut, n, m, coalesce(k0, 0) AS k, coalesce(b0, 0) AS b, unnest(range(0, CAST(coalesce(k0, 0) + 1 AS BIGINT))) AS i
  FROM rate WHERE coalesce(k0, 0) <= n * 0.005),
tail AS (
  SELECT stratum, rule, cut, n, m, k, b, sum(exp(CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(0.005) + (n - i) * ln(0.995) END)) AS p FROM term GROUP BY ALL),
safe AS (
  SELECT *, b / greatest(1, m) - k / greatest(1, n) AS gain FROM tail
  WHERE p <= 0.05 / ((SELECT count(DISTINCT stratum) FROM known) * 4 * 40)),
cuts AS (
  SELECT stratum, rule, cut FROM safe WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cut DESC) = 1),
wide AS (
  SELECT stratum, min(cut) FILTER (rule = 'symbols') AS c1, min(cut) FILTER (rule = 'dup_lines') AS c2,
    min(cut) FILTER (rule = 'repeats') AS c3, min(cut) FILTER (rule = 'long_words') AS c4 FROM cuts GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbols >= c1, false) AND NOT coalesce(dup_lines >= c2, false)
    AND NOT coalesce(repeats >= c3, false) AND NOT coalesce(long_words >= c4, false) AS kept
FROM judged LEFT JOIN wide USING (stratum)
"""


def _pattern(items: list) -> str:
    """A regular expression over words with a space behind each."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(item.replace(".", r"\.") + " ")
        elif isinstance(item, tuple):
            out.append(f"(?:[^ ]+ ){{{item[0]},{item[1]}}}")
        else:
            out.append(f"(?:{_pattern(item)})?")
    return "".join(out)


def _license_sql() -> str:
    from runweave.llm.licenses import BASE, TEMPLATES, parsed

    bases, labels = [], []
    for phrase, label in BASE.items():
        w = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w))
        bases.append(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM place WHERE {same}")
    for label, text in TEMPLATES:
        labels.append(f"SELECT doc_id, '{label}' AS label FROM word WHERE regexp_matches(joined, ' {_pattern(parsed(text))}')")
    return f"""
    WITH word AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (SELECT doc_id, {ALNUM_WORDS.format("text")} AS w FROM documents)),
    place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word),
    base AS ({" UNION ALL ".join(bases)}),
    own AS ({" UNION ALL ".join(labels)}),
    b AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM base GROUP BY 1),
    bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY 1),
    al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s
      FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM own) GROUP BY 1),
    t AS (SELECT DISTINCT doc_id, 1 AS x FROM own)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word,
      CAST(hi AS BIGINT) AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
      CAST(CASE WHEN x = 1 THEN 1 WHEN n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
    FROM word LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN t USING (doc_id)
    """


SQL["op2_licenses"] = _license_sql()

#: the 256 steps of CRC-32 (reflected polynomial 0xEDB88320) as a list
_CRC_TABLE = """
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
  FROM range(256) AS r(b)"""


def _crc32(text: str, steps: str = "steps") -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; `steps` is the list above."""
    step = f"xor(s >> 8, {steps}[(xor(s, x) & 255) + 1])"
    values = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({values}, lambda s, x: {step}, 4294967295), 4294967295)"


SQL["op11_resampling"] = f"""
WITH crc AS ({_CRC_TABLE}),
doc AS (SELECT doc_id, {ALNUM_WORDS.format("text")} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word FROM doc),
goal AS (SELECT unnest({ALNUM_WORDS.format("text")}) AS word FROM benchmark),
bucket AS (
  SELECT word, {_crc32("word")} % 10000 AS bucket
  FROM (SELECT word FROM word UNION SELECT word FROM goal), crc),
have AS (SELECT bucket, count(*) AS s FROM word JOIN bucket USING (word) GROUP BY 1),
want AS (SELECT bucket, count(*) AS t FROM goal JOIN bucket USING (word) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM word) + 10000.0 AS s_all, (SELECT count(*) FROM goal) + 10000.0 AS t_all),
gain AS (
  SELECT word, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * CAST(s_all AS DOUBLE)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * CAST(t_all AS DOUBLE)))) AS BIGINT) AS gain
  FROM bucket LEFT JOIN have USING (bucket) LEFT JOIN want USING (bucket), sums),
weighed AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM word JOIN gain USING (word) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

SQL["op13_trie"] = f"""
WITH crc AS ({_CRC_TABLE}),
turn AS (
  SELECT conv_id, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT c AS conv_id, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turn), crc),
part AS (
  SELECT c.conv_id, 0 AS own, t.i, t.k, t.words FROM conv c JOIN turn t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.k, t.words FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.i >= c.h),
seq AS (
  SELECT conv_id, list(k ORDER BY own, i) FILTER (WHERE k IS NOT NULL) AS ks, list(words ORDER BY own, i) FILTER (WHERE k IS NOT NULL) AS ws
  FROM conv LEFT JOIN part USING (conv_id) GROUP BY 1),
step AS (
  SELECT conv_id, d, array_to_string(ks[1:d], '') AS path, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, d = coalesce(len(ks), 0) AS ends
  FROM (SELECT *, unnest(range(0, coalesce(len(ks), 0) + 1)) AS d FROM seq)),
node AS (
  SELECT d, coalesce(path, '') AS path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM step GROUP BY 1, 2),
child AS (SELECT d - 1 AS d, left(path, CAST(32 * (d - 1) AS BIGINT)) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
under AS (
  SELECT x.d, x.path, CAST(sum((y.n_convs - 1) * y.words) AS BIGINT) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM node x JOIN node y ON y.d >= x.d AND left(y.path, CAST(32 * x.d AS BIGINT)) = x.path
  LEFT JOIN child c ON c.d = y.d AND c.path = y.path GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children,
  under.leaves AS n_leaves, under.saved AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN under ON under.d = node.d AND under.path = node.path
LEFT JOIN child ON child.d = node.d AND child.path = node.path
LEFT JOIN node up ON up.d = node.d - 1 AND up.path = left(node.path, CAST(32 * up.d AS BIGINT))
"""
