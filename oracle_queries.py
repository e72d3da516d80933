"""SQL that gives the same rows as the Spark queries, on the same tables, for the side-by-side check.

Written on its own terms: plain windows and self joins where the Spark side slices, sweeps or folds.
"""

from __future__ import annotations

import re

BASE, CAND = "synth_baseline_10_0101", "synth_candidate_10_0101"
CPUS = range(8)
CLUSTERS = {"little": (0, 1, 2, 3), "mid": (4, 5), "big": (6, 7)}


def _cluster(cpu: str) -> str:
    return f"CASE WHEN {cpu} < 4 THEN 'little' WHEN {cpu} < 6 THEN 'mid' ELSE 'big' END"


def _ncpu(cluster: str) -> str:
    return f"CASE {cluster} WHEN 'little' THEN 4 ELSE 2 END"


def _nth(items, index: str) -> str:
    return "(['" + "','".join(items) + f"'])[CAST({index} AS BIGINT) + 1]"


KEYS = "wa_path, iteration"
SEC = "/ 1e9"

PARTS = {
    "ev": f"""
      SELECT CASE WHEN user_id % 2 = 0 THEN '{BASE}' ELSE '{CAND}' END AS wa_path,
        CAST((day(ts) - 1) // 3 + 1 AS INTEGER) AS iteration, epoch_us(ts) * 1000 AS t_ns, event_id AS seq,
        CAST((user_id // 2) % 8 AS INTEGER) AS cpu, user_id AS pid,
        {_nth(['swapper/0', 'RenderThread', 'surfaceflinger', 'HwBinder:1', 'GameThread', 'writer'], '(user_id // 2) % 6')} AS comm,
        event_type AS type, CAST(floor(value) AS BIGINT) AS whole, CAST(round(value * 100) AS BIGINT) AS cents
      FROM events""",
    "win": f"SELECT {KEYS}, min(t_ns) AS start_ns, max(t_ns) AS end_ns, count(*) AS events FROM ev GROUP BY ALL",
    "runs": f"SELECT * FROM (VALUES ('{BASE}', '6.1.0-base', 'baseline', 0), ('{CAND}', '6.1.0-new', 'candidate', 1)) r(wa_path, kernel, tag, run_order)",
    "emeter": f"""
      SELECT {KEYS}, t_ns, seq, {_nth(['CPU(little)', 'CPU(mid)', 'CPU(big)', 'GPU', 'DDR', 'Display'], 'seq % 6')} AS channel,
        seq * 1000000000 + cents AS value FROM ev WHERE type IN ('purchase', 'view')""",
    "power": f"""
      SELECT {KEYS}, t_ns, channel, (value - was) * 1e6 / (t_ns - was_ns) AS power FROM (
        SELECT *, lag(value) OVER w AS was, lag(t_ns) OVER w AS was_ns FROM emeter
        WINDOW w AS (PARTITION BY {KEYS}, channel ORDER BY t_ns, seq)) WHERE was IS NOT NULL""",
    "idle": f"""
      SELECT {KEYS}, t_ns, seq, cpu, CAST(CASE WHEN type IN ('click', 'error') THEN -1 WHEN type = 'view' THEN 0 ELSE 1 END AS BIGINT) AS state,
        {_cluster('cpu')} AS cluster FROM ev""",
    "idle_iv": f"""
      SELECT i.*, coalesce(lead(t_ns) OVER (PARTITION BY {KEYS}, cpu ORDER BY t_ns, seq), end_ns) AS t_end_ns
      FROM idle i JOIN win USING ({KEYS})""",
    # How many CPUs of a cluster are at least k deep, between consecutive instants.
    "deep": f"""
      SELECT {KEYS}, cluster, k, t, sum(d) AS d FROM (
        SELECT {KEYS}, cluster, k, t_ns AS t, 1 AS d FROM idle_iv, (VALUES (0), (1)) l(k) WHERE state >= k
        UNION ALL SELECT {KEYS}, cluster, k, t_end_ns AS t, -1 AS d FROM idle_iv, (VALUES (0), (1)) l(k) WHERE state >= k)
      GROUP BY ALL""",
    "deep_time": f"""
      SELECT {KEYS}, cluster, k, CAST(sum(CASE WHEN n = {_ncpu('cluster')} THEN t_end - t ELSE 0 END) AS BIGINT) AS ns FROM (
        SELECT *, sum(d) OVER w AS n, coalesce(lead(t) OVER w, t) AS t_end FROM deep
        WINDOW w AS (PARTITION BY {KEYS}, cluster, k ORDER BY t))
      GROUP BY ALL""",
    "idle_res": f"""
      SELECT a.wa_path, a.iteration, a.cluster, CAST(a.k AS BIGINT) AS idle_state, (a.ns - coalesce(b.ns, 0)) {SEC} AS time
      FROM deep_time a LEFT JOIN deep_time b
      ON a.wa_path = b.wa_path AND a.iteration = b.iteration AND a.cluster = b.cluster AND b.k = a.k + 1""",
    "miss": f"SELECT {KEYS}, t_ns, cpu AS cpu_id, whole % 2 AS below, {_cluster('cpu')} AS cluster FROM ev WHERE type = 'error'",
    "freq": f"""
      SELECT {KEYS}, t_ns, seq, cpu, 300000 + (whole % 8) * 200000 AS frequency, {_cluster('cpu')} AS cluster
      FROM ev WHERE type IN ('view', 'purchase')""",
    "dom": "SELECT * FROM freq WHERE cpu IN (0, 4, 6)",
    # Instants at which a domain's frequency or any of its CPUs' idle states change, each looked up as of then.
    "dom_t": f"SELECT {KEYS}, cluster, t_ns FROM dom UNION SELECT {KEYS}, cluster, t_ns FROM idle",
    "dom_iv": f"""
      SELECT d.*, coalesce(lead(t_ns) OVER (PARTITION BY {KEYS}, cluster ORDER BY t_ns), end_ns) AS t_end_ns
      FROM dom_t d JOIN win USING ({KEYS})""",
    "dom_at": """
      SELECT d.*, f.frequency FROM dom_iv d ASOF JOIN dom f
      ON d.wa_path = f.wa_path AND d.iteration = f.iteration AND d.cluster = f.cluster AND d.t_ns >= f.t_ns""",
    "dom_cpu": "SELECT d.*, c.cpu FROM dom_at d JOIN (SELECT DISTINCT cpu, cluster FROM idle) c USING (cluster)",
    "dom_idle": f"""
      SELECT c.wa_path, c.iteration, c.cluster, c.t_ns, c.t_end_ns, c.frequency, min(coalesce(i.state, -1)) AS shallowest
      FROM dom_cpu c ASOF LEFT JOIN idle i
      ON c.wa_path = i.wa_path AND c.iteration = i.iteration AND c.cpu = i.cpu AND c.t_ns >= i.t_ns GROUP BY ALL""",
    "freq_res": f"""
      SELECT {KEYS}, cluster, frequency, CAST(sum(t_end_ns - t_ns) AS BIGINT) {SEC} AS total_time,
        CAST(coalesce(sum(t_end_ns - t_ns) FILTER (shallowest = -1), 0) AS BIGINT) {SEC} AS active_time
      FROM dom_idle GROUP BY {KEYS}, cluster, frequency""",
    "over": f"""
      SELECT {KEYS}, CAST(sum(CASE WHEN overutilized = 1 THEN t_end_ns - t_ns ELSE 0 END) AS BIGINT) {SEC} AS time,
        (any_value(end_ns) - any_value(start_ns)) {SEC} AS total_time FROM (
        SELECT {KEYS}, seq % 2 AS overutilized, t_ns, start_ns, end_ns,
          coalesce(lead(t_ns) OVER (PARTITION BY {KEYS} ORDER BY t_ns, seq), end_ns) AS t_end_ns
        FROM ev JOIN win USING ({KEYS}) WHERE type IN ('click', 'purchase')) GROUP BY {KEYS}""",
    "over_p": "SELECT *, round(time / total_time * 100, 2) AS percentage FROM over",
    "pelt": f"""
      SELECT {KEYS}, t_ns, cpu, CASE WHEN seq % 3 = 0 THEN '/background' ELSE '/' END AS path, whole % 1024 AS load,
        cents % 1024 AS util, {_cluster('cpu')} AS cluster FROM ev WHERE type = 'view'""",
    "names": f"SELECT {KEYS}, pid, string_agg(comm, ' ' ORDER BY comm) AS task FROM (SELECT DISTINCT {KEYS}, pid, comm FROM ev WHERE type <> 'signup') GROUP BY ALL",
    "clamp": f"""
      SELECT {KEYS}, t_ns, CASE WHEN whole % 10 = 0 THEN pid + 1000000000 ELSE pid END AS pid, seq % 2 AS uclamp_id,
        whole % 1024 AS value FROM ev WHERE type = 'click'""",
    "sw": "SELECT * FROM ev WHERE type <> 'signup'",
    "iv": f"""
      SELECT s.*, end_ns, coalesce(lead(t_ns) OVER (PARTITION BY {KEYS}, cpu ORDER BY t_ns, seq), end_ns) AS t_end_ns
      FROM sw s JOIN win USING ({KEYS})""",
    "cpu_ns": f"SELECT {KEYS}, pid, comm, cpu, CAST(sum(t_end_ns - t_ns) AS BIGINT) AS ns FROM iv GROUP BY ALL",
    # The next switch-in of the task after each wakeup, unless it is woken again before.
    "lat": f"""
      SELECT w.wa_path, w.iteration, w.t_ns, w.pid, w.comm, s.t_ns - w.t_ns AS ns, (s.t_ns - w.t_ns) {SEC} AS wakeup_latency, s.cpu, w.target_cpu
      FROM (SELECT {KEYS}, t_ns, pid, comm, CAST((cpu + whole) % 8 AS INTEGER) AS target_cpu,
              lead(t_ns) OVER (PARTITION BY {KEYS}, pid ORDER BY t_ns) AS again FROM ev WHERE type = 'signup') w
      ASOF JOIN sw s ON w.wa_path = s.wa_path AND w.iteration = s.iteration AND w.pid = s.pid AND w.t_ns <= s.t_ns
      WHERE again IS NULL OR again > s.t_ns""",
    "main_tasks": "SELECT unnest(['RenderThread', 'surfaceflinger', 'HwBinder:1', 'GameThread']) AS comm",
    "lat_main": "SELECT * FROM lat WHERE comm IN (SELECT comm FROM main_tasks)",
    "iv_main": "SELECT * FROM iv WHERE comm IN (SELECT comm FROM main_tasks)",
    "act_n": f"SELECT *, lead(t_ns) OVER (PARTITION BY {KEYS}, pid ORDER BY t_ns, seq) AS next_ns FROM iv_main",
    "act": f"""
      SELECT {KEYS}, pid, comm, cpu, t_ns, CAST(1 AS DOUBLE) AS active, (t_end_ns - t_ns) {SEC} AS duration,
        CAST(t_end_ns - t_ns AS DOUBLE) / nullif(CAST(next_ns - t_ns AS DOUBLE), 0) AS duty_cycle FROM act_n
      UNION ALL SELECT {KEYS}, pid, comm, cpu, t_end_ns, CAST(0 AS DOUBLE), (coalesce(next_ns, end_ns) - t_end_ns) {SEC}, NULL
      FROM act_n WHERE coalesce(next_ns, end_ns) > t_end_ns""",
    "attach": f"""
      SELECT {KEYS}, t_ns, {_nth(['/background', '/foreground', '/system-background', '/top-app'], '(pid + whole % 2) % 4')} AS dst_path,
        pid, comm FROM ev WHERE type = 'error'""",
    "member": f"SELECT DISTINCT {KEYS}, pid, comm, dst_path[2:] AS cgroup FROM attach WHERE dst_path <> '/top-app'",
    "lat_cg": f"SELECT l.*, m.cgroup FROM lat l JOIN member m USING ({KEYS}, pid, comm)",
    "ns_cg": f"SELECT n.*, m.cgroup FROM cpu_ns n JOIN member m USING ({KEYS}, pid, comm)",
    "cnt": f"""
      SELECT {KEYS}, t_ns, cpu, counter_id, value, value - lag(value) OVER (PARTITION BY {KEYS}, counter_id, cpu ORDER BY t_ns, seq) AS delta
      FROM (SELECT *, ([17, 8, 27])[seq % 3 + 1] AS counter_id, seq * 1000 + whole AS value FROM ev WHERE type IN ('error', 'view'))""",
    "cnt_long": f"""
      SELECT {KEYS}, t_ns, cpu, v.name || v.suffix AS variable, CASE WHEN v.suffix = '' THEN delta ELSE value END AS value
      FROM cnt JOIN (VALUES (17, 'CPU_CYCLES', ''), (8, 'INST_RETIRED', ''), (27, 'INST_SPEC', ''), (17, 'CPU_CYCLES', '-Total'),
        (8, 'INST_RETIRED', '-Total'), (27, 'INST_SPEC', '-Total')) v(id, name, suffix) ON v.id = counter_id WHERE delta IS NOT NULL""",
    "frames0": f"""
      SELECT {KEYS}, t_ns - 8000000 AS desired, t_ns AS present, t_ns - cents * 1000 AS ready FROM ev WHERE type IN ('purchase', 'click')""",
    "frames": f"""
      SELECT {KEYS}, present / 1e6 / 1000 AS ts, (present - first_present) / 1e6 / 1000 AS ts_iter, desired / 1e6 / 1000 AS desired_ts,
        ready / 1e6 / 1000 AS ready_ts, (present - was) / 1e6 AS render_time, (ready - was_ready) / 1e6 AS render_ready_time
      FROM (SELECT *, lag(present) OVER w AS was, lag(ready) OVER w AS was_ready, first_value(present) OVER w AS first_present
        FROM frames0 WINDOW w AS (PARTITION BY {KEYS} ORDER BY present, ready, desired)) WHERE was IS NOT NULL""",
    "therm": f"""
      SELECT {KEYS}, t_ns / 1e9 AS "Time", 30000 + cents % 20000 AS big, 30000 + (cents * 2) % 20000 AS mid,
        30000 + (cents * 3) % 20000 AS little FROM ev WHERE type = 'view'""",
    "report": f"""
      SELECT {KEYS}, t_ns / 1e9 AS time, CAST(seq AS DOUBLE) AS "# frame count", CAST(whole % 60 + 1 AS DOUBLE) AS "average fps",
        CAST(whole % 5 AS DOUBLE) AS "sigma fps", CAST(whole % 3 AS DOUBLE) AS "thermal status", cents FROM ev WHERE type = 'signup'""",
    # Each CPU's frequency and idle state as of every instant either changes.
    "chg": f"SELECT {KEYS}, cpu, t_ns FROM freq UNION SELECT {KEYS}, cpu, t_ns FROM idle",
    "chg_iv": f"""
      SELECT c.*, coalesce(lead(t_ns) OVER (PARTITION BY {KEYS}, cpu ORDER BY t_ns), end_ns) AS t_end_ns
      FROM chg c JOIN win USING ({KEYS})""",
    "chg_f": """
      SELECT c.*, f.frequency FROM chg_iv c ASOF LEFT JOIN freq f
      ON c.wa_path = f.wa_path AND c.iteration = f.iteration AND c.cpu = f.cpu AND c.t_ns >= f.t_ns""",
    "chg_fi": """
      SELECT c.*, coalesce(i.state, -1) AS state FROM chg_f c ASOF LEFT JOIN idle i
      ON c.wa_path = i.wa_path AND c.iteration = i.iteration AND c.cpu = i.cpu AND c.t_ns >= i.t_ns""",
    "cpu_power": f"""
      SELECT {KEYS}, cpu, t_ns, CASE WHEN state = -1
        THEN (CASE {_cluster('cpu')} WHEN 'little' THEN 20.0 WHEN 'mid' THEN 60.0 ELSE 150.0 END) * ((frequency - 300000) // 200000 + 1)
        ELSE (CASE {_cluster('cpu')} WHEN 'little' THEN 8.0 WHEN 'mid' THEN 12.0 ELSE 24.0 END) / (state + 1) END AS power
      FROM chg_fi WHERE t_end_ns > t_ns""",
    "pow_t": f"SELECT DISTINCT {KEYS}, t_ns FROM cpu_power WHERE power IS NOT NULL",
    "pow_at": f"""
      SELECT t.wa_path, t.iteration, t.t_ns, c.cpu, p.power FROM (SELECT t.*, unnest(range(8)) AS cpu FROM pow_t t) t
      ASOF LEFT JOIN (SELECT * FROM cpu_power WHERE power IS NOT NULL) p
      ON t.wa_path = p.wa_path AND t.iteration = p.iteration AND t.cpu = p.cpu AND t.t_ns >= p.t_ns
      JOIN (SELECT unnest(range(8)) AS cpu) c ON c.cpu = t.cpu""",
    "energy": f"""
      SELECT {KEYS}, t_ns, """ + ", ".join(
        f"CAST(max(power) FILTER (cpu = {c}) AS DOUBLE) AS cpu{c}" for c in CPUS
    ) + "".join(
        f", CAST(coalesce(sum(power) FILTER (cpu IN {m}), 0) AS DOUBLE) AS {n}" for n, m in CLUSTERS.items()
    ) + f", CAST(sum(power) AS DOUBLE) AS total FROM pow_at GROUP BY {KEYS}, t_ns",
}

ADPF_FEATURES = (
    "Adaptive Batching", "Adaptive Decals", "Adaptive Framerate", "Adaptive LOD", "Adaptive Lut",
    "Adaptive MSAA", "Adaptive Resolution", "Adaptive Shadow Cascade", "Adaptive Shadow Distance",
    "Adaptive Shadowmap Resolution", "Adaptive Shadow Quality", "Adaptive Transparency",
    "Adaptive View Distance", "Adaptive Sorting", "Adaptive Physics", "Adaptive Layer Culling", "Adaptive Fog",
)


def with_parts(body: str, parts: dict[str, str] | None = None) -> str:
    """``body`` with the named parts it uses, and those they use, in front."""
    parts = parts or PARTS
    needed: list[str] = []

    def need(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(parts[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    ctes = ",\n".join(f"{name} AS ({parts[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{body.strip()}" if needed else body.strip()


def tagged(part: str, columns: str) -> str:
    return f"SELECT wa_path, kernel, iteration, {columns} FROM {part} JOIN runs USING (wa_path)"


TIMED = 't_ns / 1e9 AS "Time"'


def _residency(rows: str, keys: str = "") -> str:
    groups = {f"cpu{c}": f"({c})" for c in CPUS} | {n: str(m) for n, m in CLUSTERS.items()}
    sums = ", ".join(
        f"CAST(coalesce(sum(ns) FILTER (cpu IN {m}), 0) AS BIGINT) / 1e9 AS {n}" for n, m in groups.items()
    )
    keys = f", {keys}" if keys else ""
    return (
        f'SELECT wa_path, kernel, iteration{keys}, {sums}, CAST(sum(ns) AS BIGINT) / 1e9 AS "Total" '
        f"FROM {rows} JOIN runs USING (wa_path) GROUP BY wa_path, kernel, iteration{keys}"
    )


def _mean(part: str, keys: str, means: str, kernel: bool = True) -> str:
    k = "kernel, " if kernel else ""
    keys = f", {keys}" if keys else ""
    return f"SELECT wa_path, {k}iteration{keys}, {means} FROM {part} JOIN runs USING (wa_path) GROUP BY wa_path, {k}iteration{keys}"


LAT_MEAN = "CAST(sum(ns) AS BIGINT) / 1e9 / count(*) AS wakeup_latency"
POWERS = [f"cpu{c}" for c in CPUS] + ["little", "mid", "big", "total"]
STATS = "count(*) AS count, CAST(sum(t_end_ns - t_ns) AS BIGINT) / 1e9 AS duration"

DATASETS = {
    "pixel6_emeter": tagged("power", f"{TIMED}, channel, round(power, 6) AS power"),
    "pixel6_emeter_mean": _mean("power", "channel", "round(avg(power), 6) AS power"),
    "cpu_idle": tagged("idle", f"{TIMED}, cpu, state, cluster"),
    "idle_residency": tagged("idle_res", "cluster, idle_state, time"),
    "cpu_idle_miss": tagged("miss", f"{TIMED}, cpu_id, below, cluster"),
    "cpu_idle_miss_counts": _mean("miss", "cluster, below", "count(*) AS count"),
    "freqs": tagged("freq", f"{TIMED}, frequency, cluster, cpu"),
    "freqs_mean": _mean("dom", "cluster", "avg(frequency) / 1000 AS frequency"),
    "freqs_residency": tagged("freq_res", "cluster, frequency, total_time, active_time"),
    "overutilized": tagged("over_p", "time, total_time, percentage"),
    "overutilized_mean": """
      SELECT 'overutilized' AS metric, wa_path, round(avg(time), 2) AS time, round(avg(total_time), 2) AS total_time,
        round(avg(percentage), 2) AS percentage FROM over_p GROUP BY wa_path""",
    "sched_pelt_cfs": tagged("pelt", f"{TIMED}, cpu, path, load, util, cluster"),
    "sched_pelt_cfs_root": tagged("pelt", f"{TIMED}, cpu, path, load, util, cluster") + " WHERE path = '/'",
    "sched_pelt_cfs_mean": _mean(
        "pelt", "cluster", "avg(load) FILTER (path = '/') AS load, avg(util) FILTER (path = '/') AS util"
    ) + " HAVING count(*) FILTER (path = '/') > 0",
    "capacity": f"""
      SELECT wa_path, kernel, iteration, {TIMED}, cpu, 1024 - whole % 512 AS capacity, (t_ns - start_ns) / 1e9 AS time_it
      FROM ev JOIN win USING ({KEYS}) JOIN runs USING (wa_path) WHERE type = 'signup'""",
    "uclamp_updates": f"""
      SELECT wa_path, kernel, iteration, {TIMED}, pid, uclamp_id, value, coalesce(task, '<unknown>') AS task,
        (t_ns - start_ns) / 1e9 AS time_it
      FROM clamp JOIN win USING ({KEYS}) JOIN runs USING (wa_path) LEFT JOIN names USING ({KEYS}, pid)""",
    "adpf": tagged("report", 'time, "# frame count", "average fps", "sigma fps", "thermal status", ' + ", ".join(
        f'CAST((cents + {i}) % 10 AS DOUBLE) AS "{prefix}{f}"' for i, f in enumerate(ADPF_FEATURES) for prefix in ("", "sn_")
    )),
    "adpf_totals": _mean(
        "report", "", 'avg("average fps") AS "average fps", arg_max("# frame count", time) AS "frame count"'
    ),
    "thermal": tagged("therm", '"Time", big, mid, little'),
    "fps": tagged("frames", "ts, ts_iter, desired_ts, ready_ts, render_time, render_ready_time"),
    "wakeup_latency": tagged("lat_main", f"{TIMED}, pid, comm, wakeup_latency, cpu, target_cpu"),
    "wakeup_latency_mean": f"SELECT {KEYS}, comm, {LAT_MEAN} FROM lat_main WHERE comm NOT LIKE 'Hw%' GROUP BY ALL",
    "task_activations": tagged("act", f"{TIMED}, pid, comm, cpu, active, duration, duty_cycle"),
    "task_activations_stats": _mean("iv_main", "cpu, cluster, comm", STATS).replace(
        "FROM iv_main", f"FROM (SELECT *, {_cluster('cpu')} AS cluster FROM iv_main)"),
    "task_activations_stats_cluster": _mean("iv_main", "cluster, comm", STATS).replace(
        "FROM iv_main", f"FROM (SELECT *, {_cluster('cpu')} AS cluster FROM iv_main)"),
    "perf_counters": tagged("cnt_long", f"{TIMED}, cpu, variable, value"),
    "tasks_residency": _residency("cpu_ns", "pid, comm"),
    "tasks_residency_total": _residency("cpu_ns", "comm"),
    "tasks_residency_cpu_total": _residency("(SELECT * FROM cpu_ns WHERE comm NOT LIKE 'swapper%')"),
    "cgroup_attach_task": tagged("attach", f"{TIMED}, dst_path, pid, comm"),
    "wakeup_latency_cgroup": tagged("lat_cg", f"{TIMED}, cgroup, pid, comm, wakeup_latency, cpu, target_cpu"),
    "wakeup_latency_cgroup_mean": f"SELECT {KEYS}, cgroup, {LAT_MEAN} FROM lat_cg GROUP BY ALL",
    "tasks_residency_cgroup": _residency("ns_cg", "cgroup, comm"),
    "tasks_residency_cgroup_total": _residency("ns_cg", "cgroup"),
    "energy_estimate": tagged("energy", f"{TIMED}, " + ", ".join(POWERS)),
    "energy_estimate_mean": _mean("energy", "", ", ".join(f"avg({c}) AS {c}" for c in POWERS)).replace(
        "SELECT ", "SELECT 'energy-estimate' AS metric, ", 1),
}


# ---- across runs -------------------------------------------------------------------------------

TAGGED = "JOIN (SELECT wa_path, tag, run_order FROM runs) USING (wa_path)"
CLUSTER_RANK = "CASE {} WHEN 'little' THEN 0 WHEN 'mid' THEN 1 WHEN 'big' THEN 2 ELSE 3 END"
RANK = CLUSTER_RANK.format("cluster")
TAG_RANK = "CAST(CASE tag WHEN 'baseline' THEN 0 ELSE 1 END AS BIGINT)"
CLUSTERS_TOTAL = [*CLUSTERS, "total"]
CPU_COLUMNS = [f"cpu{c}" for c in CPUS]


def _melt(part: str, ids: str, columns, variable="variable") -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS {variable}, CAST(\"{c}\" AS DOUBLE) AS value FROM {part}" for c in columns
    )


def _half_up(x: str) -> str:
    """Two decimals, ties away from zero as the printed number reads."""
    return f"CAST(round(CAST({x} AS DECIMAL(30, 12)), 2) AS DOUBLE)"


def _human(x: str) -> str:
    return f"""CASE WHEN {x} > 1e9 THEN CAST(round({x} / 1e9, 3) AS VARCHAR) || 'B'
      WHEN {x} > 1e6 THEN CAST(round({x} / 1e6, 3) AS VARCHAR) || 'M'
      WHEN {x} > 1e4 THEN CAST(round({x} / 1e3, 2) AS VARCHAR) || 'k'
      WHEN {x} <> 0 AND abs({x}) < 0.01 THEN CAST(round({x} * 1e6, 2) AS VARCHAR) || 'μ'
      ELSE CAST({x} AS VARCHAR) END"""


def _compare(rows: str, facets, value="value", digits=1, percentage=True, metric="'gmean'", unit="'x'", labels=True) -> str:
    """Statistics per tag and facet; change and Kolmogorov-Smirnov test against the baseline.

    The test's p-value is the closed form for equal sample sizes and, for others, one less the share
    of lattice paths that stay inside the band, counted step by step.
    """
    by = ", ".join(facets)
    using = f"USING ({by})" if facets else "ON true"
    plus = f", {by}" if facets else ""
    per = f"PARTITION BY {by} " if facets else ""
    rnd = f"round({{}}, {digits})" if digits else "{}"
    final = f"round({{}}, {digits})" if digits else "round({}, 6)"
    body = f"""
      SELECT s.*, ref.g AS ref_g FROM (
        SELECT tag{plus}, count({value}) AS n,
          CASE WHEN min({value}) < 0 THEN NULL WHEN min({value}) = max({value}) THEN min({value}) WHEN min({value}) = 0 THEN 0
            ELSE exp(avg(CASE WHEN {value} > 0 THEN ln({value}) END)) END AS g,
          stddev_samp({value}) AS sd FROM rows_ GROUP BY tag{plus}) s
      LEFT JOIN (SELECT {by + ', ' if facets else ''}CASE WHEN min({value}) = max({value}) THEN min({value}) WHEN min({value}) = 0 THEN 0 ELSE exp(avg(CASE WHEN {value} > 0 THEN ln({value}) END)) END AS g
        FROM rows_ WHERE tag = 'baseline' {'GROUP BY ' + by if facets else ''}) ref {using}"""
    test = f"""
      SELECT 'candidate' AS tag{plus}, max(abs(own * m - base * n)) AS gap, any_value(n) AS n, any_value(m) AS m FROM (
        SELECT *, sum(o) OVER ({per}ORDER BY v) AS own, sum(b) OVER ({per}ORDER BY v) AS base,
          sum(o) OVER ({per}) AS n, sum(b) OVER ({per}) AS m FROM (
          SELECT {by + ', ' if facets else ''}{value} AS v, count(*) FILTER (tag = 'candidate') AS o, count(*) FILTER (tag = 'baseline') AS b
          FROM rows_ GROUP BY ALL)) {'GROUP BY ' + by if facets else ''}"""
    step = f"SELECT {by + ', ' if facets else ''}n, m, gap, {{}} AS i, {{}} AS j, inside, paths FROM paths_"
    paths = f"""
      SELECT {by + ', ' if facets else ''}n, m, gap, 0 AS i, 0 AS j, CAST(1 AS DOUBLE) AS inside, CAST(1 AS DOUBLE) AS paths FROM tests_ WHERE n <> m
      UNION ALL SELECT {by + ', ' if facets else ''}n, m, gap, i, j, sum(CASE WHEN abs(i * m - j * n) < gap THEN inside ELSE 0 END), sum(paths)
      FROM ({step.format('i + 1', 'j')} UNION ALL {step.format('i', 'j + 1')}) WHERE i <= n AND j <= m
      GROUP BY {by + ', ' if facets else ''}n, m, gap, i, j"""
    ends = f"SELECT {by + ', ' if facets else ''}1 - inside / paths AS p_path FROM paths_ WHERE i = n AND j = m"
    p = """CASE WHEN gap = 0 THEN 1.0 WHEN n <> m THEN p_path WHEN n = m THEN least(1.0, greatest(0.0, 2 * list_sum(list_transform(
        range(1, CAST(n // (gap // n) AS BIGINT) + 1),
        lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * list_product(list_transform(
          range(1, CAST(k * (gap // n) AS BIGINT) + 1),
          lambda j: CAST(n - k * (gap // n) + j AS DOUBLE) / CAST(n + j AS DOUBLE))))))) END"""
    change = "CASE WHEN s.tag = 'baseline' AND ref_g <> 0 THEN 0.0 ELSE (g / nullif(ref_g, 0) - 1) * 100 END"
    out = [
        "s.tag", *[f"s.{f}" for f in facets], "s.n", f"{final.format('g')} AS value", f"round({rnd.format('sd')}, 6) AS std",
        f"round({rnd.format('sd / sqrt(s.n)')}, 6) AS sem", TAG_RANK.replace("tag", "s.tag") + " AS order_tag",
    ]
    if "metric" not in facets:
        out.append(f"{metric} AS metric")
    if "unit" not in facets:
        out.append(f"{unit} AS unit")
    if "cluster" in facets:
        out.append(CLUSTER_RANK.format("s.cluster") + " AS order_cluster")
    if labels:
        out.append(f"{_human(rnd.format('g'))} AS value_label")
    if percentage:
        pc = f"(round({change}, 2) + 0.0)"
        out += [
            f"round({change}, 6) AS perc_diff", "gap / (t.n * t.m) AS ks_d", f"round(p, 9) AS ks_p",
            "coalesce(p < 0.02, false) AS significant", f"CAST({pc} AS VARCHAR) || '%' AS perc_label",
        ]
        if labels:
            out.append(
                f"{_human(rnd.format('g'))} || coalesce(' ' || CASE WHEN p < 0.02 THEN '* ' ELSE '' END || '(' || "
                f"CASE WHEN {pc} > 0 THEN '+' ELSE '' END || CAST({pc} AS VARCHAR) || '%)', '') AS bar_label"
            )
    tests = f"LEFT JOIN (SELECT *, {p} AS p FROM tests_ LEFT JOIN ({ends}) {using}) t USING (tag{plus})" if percentage else ""
    ctes = f"rows_ AS MATERIALIZED ({rows})" + (f", tests_ AS MATERIALIZED ({test}), paths_ AS ({paths})" if percentage else "")
    return f"WITH RECURSIVE {ctes} SELECT {', '.join(out)} FROM ({body}) s {tests}"


def _line(part: str, facets: str = "", value="value", x="iteration") -> str:
    facets = f", {facets}" if facets else ""
    return f"SELECT tag, {TAG_RANK} AS order_tag{facets}, {x}, {value} AS value FROM {part}"


COUNTERS = (
    "cpu-migrations", "context-switches", "stalled-cycles-backend", "page-faults",
    "major-faults", "cache-misses", "instructions", "cpu-cycles", "cpu-clock",
)
QUANTILES = "(0.9), (0.95), (0.99)"


def _quantile(part: str, keys: str, value: str) -> str:
    return f"""
      SELECT {keys}, CAST(q AS DOUBLE) AS quantile, round(v, 9) AS {value}, {TAG_RANK} AS "order" FROM (
        SELECT {keys}, unnest([0.9, 0.95, 0.99]) AS q, unnest(quantile_cont({value}, [0.9, 0.95, 0.99])) AS v
        FROM {part} GROUP BY {keys})"""


PARTS |= {f"m_{name}": body for name, body in DATASETS.items()}
_IDS = "iteration, tag, kernel"
_FRAMES = f"""
  SELECT CASE WHEN l_suppkey % 2 = 0 THEN '{BASE}' ELSE '{CAND}' END AS wa_path, CAST(l_orderkey % 10 + 1 AS INTEGER) AS iteration,
    l_extendedprice, l_returnflag FROM lineitem"""
RUNS = {
    "results_all": f"""
      SELECT wa_path, iteration, metric, test_name, CAST(sum(cents) AS BIGINT) / 100 / count(*) AS value, tag FROM (
        SELECT CASE WHEN o_custkey % 2 = 0 THEN '{BASE}' ELSE '{CAND}' END AS wa_path,
          CAST((day(o_orderdate) - 1) // 3 + 1 AS INTEGER) AS iteration,
          CASE o_orderstatus WHEN 'P' THEN 'perf-0-' || {_nth(COUNTERS, 'o_orderkey % 9')} WHEN 'O' THEN 'jank_p' ELSE 'mean' END AS metric,
          CASE WHEN o_orderkey % 50 = 0 THEN 'idle' ELSE o_orderpriority END AS test_name,
          CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders)
      {TAGGED} GROUP BY ALL""",
    "results": "SELECT * FROM r_results_all WHERE value <> 0 AND metric NOT LIKE '%perf%'",
    "results_perf": "SELECT wa_path, iteration, metric[8:] AS metric, test_name, value, tag FROM r_results_all WHERE value <> 0 AND metric LIKE '%perf%'",
    "jankbench": f"""
      SELECT wa_path, iteration, 'total_duration' AS variable, l_extendedprice AS value, tag FROM ({_FRAMES}) {TAGGED}
      UNION ALL SELECT wa_path, iteration, 'jank_frame', CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END, tag FROM ({_FRAMES}) {TAGGED}""",
    "jb_max_frame_duration": "SELECT tag, max(iteration) AS iteration, max(value) AS value, 'max_frame_duration' AS variable FROM r_jankbench WHERE variable = 'total_duration' GROUP BY tag",
    "jb_mean_frame_duration": "SELECT tag, iteration, avg(value) AS value, 'mean_frame_duration' AS variable FROM r_jankbench WHERE variable = 'total_duration' GROUP BY tag, iteration",
    "jankbench_percs": "SELECT tag, iteration, count(*) AS count, count(*) FILTER (value = 1.0) AS jank_count, round(count(*) FILTER (value = 1.0) / count(*) * 100, 2) AS perc, 'jank_percentage' AS variable FROM r_jankbench WHERE variable = 'jank_frame' GROUP BY tag, iteration",
    "adpf": f"SELECT m.*, tag, CAST(row_number() OVER (PARTITION BY wa_path ORDER BY iteration, time) - 1 AS INTEGER) AS ts FROM m_adpf m {TAGGED}",
    "adpf_totals": f"SELECT m.*, tag FROM m_adpf_totals m {TAGGED}",
    "adpf_totals_melt": _melt("r_adpf_totals", "iteration, tag", ["average fps", "frame count"]),
    "ds_adpf": 'SELECT * EXCLUDE (wa_path, kernel, iteration, time, "# frame count") FROM r_adpf',
    "emeter_means": "SELECT tag, kernel, iteration, channel, avg(power) AS power FROM power JOIN runs USING (wa_path) GROUP BY ALL",
    "pixel6_emeter_mean": """
      SELECT * FROM r_emeter_means
      UNION ALL SELECT tag, kernel, iteration, 'CPU', sum(power) FROM r_emeter_means WHERE channel LIKE 'CPU%' GROUP BY ALL
      UNION ALL SELECT tag, kernel, iteration, 'Total', sum(power) FROM r_emeter_means GROUP BY ALL""",
    "overutilized": f"SELECT m.* EXCLUDE (time, total_time), round(time, 2) AS time, round(total_time, 2) AS total_time, tag FROM m_overutilized m {TAGGED}",
    "overutilized_mean": f"SELECT m.*, tag FROM m_overutilized_mean m {TAGGED}",
    "freqs_mean": f"SELECT m.* EXCLUDE (frequency), frequency AS value, 'MHz' AS unit, 'frequency' AS metric, {RANK} AS \"order\", tag FROM m_freqs_mean m {TAGGED}",
    "thermal": f"""SELECT iteration, kernel, wa_path, tag, round(avg("Time"), 2) AS "Time", {_half_up('avg(little) / 1000')} AS little,
      {_half_up('avg(mid) / 1000')} AS mid, {_half_up('avg(big) / 1000')} AS big FROM m_thermal {TAGGED} GROUP BY iteration, kernel, wa_path, tag""",
    "thermal_melt": _melt("r_thermal", _IDS, CLUSTERS, "cluster"),
    "idle_residency": f"SELECT tag, cluster, idle_state, round(avg(time), 2) AS time FROM m_idle_residency {TAGGED} GROUP BY ALL",
    "cpu_idle_miss_counts": f"""
      SELECT c.wa_path, kernel, cluster, below, CAST(sum(count) AS BIGINT) AS count, tag,
        round(sum(count) / any_value(wakeups) * 100, 3) AS count_perc,
        CASE below WHEN 0 THEN 'too deep' ELSE 'too shallow' END AS type, {RANK} AS "order"
      FROM m_cpu_idle_miss_counts c JOIN (SELECT wa_path, count(*) AS wakeups FROM idle WHERE state = -1 GROUP BY wa_path) w USING (wa_path)
      {TAGGED} GROUP BY c.wa_path, kernel, cluster, below, tag""",
    "energy_estimate_mean": f"SELECT m.*, tag FROM m_energy_estimate_mean m {TAGGED}",
    "energy_estimate_melt": _melt("r_energy_estimate_mean", "iteration, tag", CLUSTERS_TOTAL, "cluster"),
    "sched_pelt_cfs_mean": f"SELECT m.*, tag FROM m_sched_pelt_cfs_mean m {TAGGED}",
    "sched_pelt_cfs_melt": _melt("r_sched_pelt_cfs_mean", _IDS + ", cluster", ["util", "load"]),
    "wakeup_latency_mean": f"SELECT wa_path, iteration, comm, wakeup_latency AS value, tag, {TAG_RANK} AS \"order\", 'x' AS unit FROM m_wakeup_latency_mean {TAGGED}",
    "wakeup_latency": f"""
      SELECT *, {RANK} AS order_cluster, {CLUSTER_RANK.format('target_cluster')} AS order_target_cluster FROM (
        SELECT m.*, tag, {TAG_RANK} AS "order", {_cluster('cpu')} AS cluster, {_cluster('target_cpu')} AS target_cluster
        FROM m_wakeup_latency m {TAGGED})""",
    "wakeup_latency_quantiles": _quantile("r_wakeup_latency", "comm, tag, iteration", "wakeup_latency"),
    "wakeup_latency_execution_cluster": f"SELECT comm, tag, cluster, {LAT_MEAN} FROM (SELECT *, {_cluster('cpu')} AS cluster FROM lat_main {TAGGED}) GROUP BY comm, tag, cluster",
    "wakeup_latency_target_cluster": f"SELECT comm, tag, target_cluster, {LAT_MEAN} FROM (SELECT *, {_cluster('target_cpu')} AS target_cluster FROM lat_main {TAGGED}) GROUP BY comm, tag, target_cluster",
    "wakeup_latency_cgroup": f"SELECT m.* EXCLUDE (wakeup_latency), wakeup_latency AS value, tag, {TAG_RANK} AS \"order\" FROM m_wakeup_latency_cgroup m {TAGGED}",
    "wakeup_latency_cgroup_mean": f"SELECT tag, cgroup, iteration, {TAG_RANK} AS \"order\", {LAT_MEAN.replace('wakeup_latency', 'value')} FROM lat_cg {TAGGED} GROUP BY tag, cgroup, iteration",
    "wakeup_latency_cgroup_quantiles": _quantile("r_wakeup_latency_cgroup", "cgroup, tag, iteration", "value"),
    "tasks_residency_cpu_total": f'SELECT m.* EXCLUDE ("Total"), "Total" AS total, tag FROM m_tasks_residency_cpu_total m {TAGGED}',
    "tasks_residency_cpu_total_melt": _melt("r_tasks_residency_cpu_total", _IDS, CPU_COLUMNS, "cpu"),
    "tasks_residency_cpu_total_cluster_melt": _melt("r_tasks_residency_cpu_total", _IDS, CLUSTERS_TOTAL, "cluster"),
    "tasks_residency_total": f'SELECT m.* EXCLUDE ("Total"), "Total" AS total, tag FROM m_tasks_residency_total m {TAGGED} WHERE comm IN (SELECT comm FROM main_tasks)',
    "tasks_residency_total_melt": _melt("r_tasks_residency_total", _IDS + ", comm", CPU_COLUMNS, "cpu"),
    "tasks_residency_total_cluster_melt": _melt("r_tasks_residency_total", _IDS + ", comm", CLUSTERS_TOTAL, "cluster"),
    "tasks_residency": f'SELECT m.* EXCLUDE ("Total"), "Total" AS total, tag FROM m_tasks_residency m {TAGGED} WHERE comm IN (SELECT comm FROM main_tasks)',
    "tasks_residency_cluster_melt": _melt("r_tasks_residency", _IDS + ", comm", CLUSTERS_TOTAL, "cluster"),
    "tasks_residency_cgroup_total": f'SELECT tag, cgroup, iteration, "Total" AS total, little, mid, big, {", ".join(CPU_COLUMNS)} FROM m_tasks_residency_cgroup_total {TAGGED}',
    "cgroup_residency_total_melt": _melt("r_tasks_residency_cgroup_total", "iteration, tag, cgroup", CPU_COLUMNS, "cpu"),
    "cgroup_residency_total_cluster_melt": _melt("r_tasks_residency_cgroup_total", "iteration, tag, cgroup", CLUSTERS_TOTAL, "cluster"),
    "task_activations_stats_cluster": f"SELECT m.*, tag FROM m_task_activations_stats_cluster m {TAGGED}",
    "task_activations_stats_cluster_melt": _melt("r_task_activations_stats_cluster", "kernel, tag, iteration, cluster, comm", ["count", "duration"]),
    "task_activations": f"SELECT m.*, tag FROM m_task_activations m {TAGGED}",
    "uclamp_updates": f"SELECT m.*, tag FROM m_uclamp_updates m {TAGGED} WHERE task <> '<unknown>'",
    "fps": f"SELECT m.*, tag FROM m_fps m {TAGGED}",
    "frame_target_counts": "SELECT tag, iteration, render_time < 1000.0 / 0.005 AS on_target, count(*) AS count FROM r_fps GROUP BY ALL",
    "capacity": f"SELECT m.*, tag FROM m_capacity m {TAGGED}",
}
PARTS |= {f"r_{name}": body for name, body in RUNS.items()}


def _rounded(part: str, column: str) -> str:
    return f"SELECT * REPLACE (round({column}, 6) AS {column}) FROM {part}"


def _from(part: str) -> str:
    return f"SELECT * FROM {part}"


_SCORES = "SELECT * FROM r_results WHERE metric IN ('jank_p', 'mean')"
_COUNTED = "SELECT * FROM r_results_perf"
_DURATIONS = "SELECT tag, value FROM r_jankbench WHERE variable = 'total_duration'"


def _activation(variable: str) -> str:
    rows = f"SELECT * FROM r_task_activations_stats_cluster_melt WHERE variable = '{variable}' AND comm IN (SELECT comm FROM main_tasks)"
    return _compare(rows, ["comm", "cluster"], percentage=False)


VIEWS = {
    "results_line": _line(f"({_SCORES})", "metric"),
    "results_bar": _compare(_SCORES, ["metric", "test_name"]),
    "perf_line": _line(f"({_COUNTED})", "metric"),
    "perf_bar": _compare(_COUNTED, ["metric", "test_name"]),
    "jankbench_max_frame_durations": _compare(_from("r_jb_max_frame_duration"), ["variable"]),
    "jankbench_mean_frame_durations_line": f"SELECT * REPLACE (round(value, 6) AS value) FROM ({_line('r_jb_mean_frame_duration')})",
    "jankbench_mean_frame_durations_bar": _compare(_from("r_jb_mean_frame_duration"), ["variable"]),
    "jankbench_frame_durations_hist": f"""
      SELECT tag, bin, low + bin * width AS bin_start, count(*) AS count FROM (
        SELECT tag, low, width, least(CAST(floor((value - low) / width) AS BIGINT), 39) AS bin FROM ({_DURATIONS}),
          (SELECT min(value) AS low, (max(value) - min(value)) / 40.0 AS width FROM ({_DURATIONS}))) GROUP BY tag, bin, low, width""",
    "jankbench_frame_durations_ecdf": f"SELECT DISTINCT tag, value, cume_dist() OVER (PARTITION BY tag ORDER BY value) AS ecdf FROM ({_DURATIONS})",
    "jankbench_jank_percentage_line": _line("r_jankbench_percs", value="perc"),
    "jankbench_jank_percentage_bar": _compare(_from("r_jankbench_percs"), ["variable"], "perc"),
    "jankbench_metric_line": _line("r_results", "test_name, metric"),
    "jankbench_jank_percentage_metric_bar": _compare("SELECT * FROM r_results WHERE metric = 'jank_p'", ["metric", "test_name"]),
    "jankbench_mean_duration_metric_bar": _compare("SELECT * FROM r_results WHERE metric = 'mean'", ["metric", "test_name"]),
    "drarm_adpf_fps_line": _line("r_adpf_totals_melt", "variable"),
    "drarm_adpf_fps_bar": _compare(_from("r_adpf_totals_melt"), ["variable"]),
    "drarm_adpf_metric_line": _line(
        "(" + _melt("r_ds_adpf", "ts, tag", ["average fps", "thermal status", "Adaptive LOD"], "metric") + ")", "metric", x="ts"),
    "power_meter_line": f"SELECT * REPLACE (round(value, 6) AS value) FROM ({_line('r_pixel6_emeter_mean', 'channel', 'power')})",
    "power_meter_bar": _compare(_from("r_pixel6_emeter_mean"), ["channel"], "power"),
    "overutilized_table": "SELECT metric, tag, time, total_time, percentage FROM r_overutilized_mean",
    "overutilized_line": _line("r_overutilized", value="percentage"),
    "frequency_line": _line("r_freqs_mean", "cluster"),
    "frequency_bar": _compare(_from("r_freqs_mean"), ["metric", "cluster"], unit="'MHz'"),
    "thermal_line": _line("r_thermal_melt", "cluster"),
    "thermal_bar": _compare(_from("r_thermal_melt"), ["cluster"]),
    "idle_miss_bar": "SELECT tag, type, round(sum(count_perc), 6) AS count_perc FROM r_cpu_idle_miss_counts GROUP BY tag, type",
    "energy_estimate_line": _line("r_energy_estimate_melt", "cluster"),
    "energy_estimate_bar": _compare(_from("r_energy_estimate_melt"), ["cluster"]),
    "sched_pelt_cfs_line": _line("r_sched_pelt_cfs_melt", "cluster, variable"),
    "sched_pelt_cfs_bar": _compare(_from("r_sched_pelt_cfs_melt"), ["cluster", "variable"]),
    "wakeup_latency_line": _line("r_wakeup_latency_mean", "comm"),
    "idle_residency_bar": "SELECT * FROM r_idle_residency",
    "wakeup_latency_bar": _compare(_from("r_wakeup_latency_mean"), ["comm"], digits=0),
    "wakeup_latency_quantiles_bar": _compare(_from("r_wakeup_latency_quantiles"), ["comm", "quantile"], "wakeup_latency", 0),
    "wakeup_latency_execution_cluster_bar": f"SELECT *, {_human('wakeup_latency')} AS label FROM r_wakeup_latency_execution_cluster",
    "wakeup_latency_target_cluster_bar": f"SELECT *, {_human('wakeup_latency')} AS label FROM r_wakeup_latency_target_cluster",
    "wakeup_latency_cgroup_line": _line("r_wakeup_latency_cgroup_mean", "cgroup"),
    "wakeup_latency_cgroup_bar": _compare(_from("r_wakeup_latency_cgroup_mean"), ["cgroup"], digits=0),
    "wakeup_latency_cgroup_quantiles_bar": _compare(_from("r_wakeup_latency_cgroup_quantiles"), ["cgroup", "quantile"], digits=0),
    "tasks_cpu_residency_cluster_line": _line("r_tasks_residency_cpu_total_cluster_melt", "cluster"),
    "tasks_cpu_residency_cluster_bar": _compare(_from("r_tasks_residency_cpu_total_cluster_melt"), ["cluster"]),
    "tasks_cpu_residency_per_task_bar": _compare(_from("r_tasks_residency_total_cluster_melt"), ["comm", "cluster"]),
    "tasks_cpu_residency_cpu_bar": _compare(_from("r_tasks_residency_total_melt"), ["comm", "cpu"]),
    "cgroup_cpu_residency_cluster_bar": _compare(_from("r_cgroup_residency_total_cluster_melt"), ["cgroup", "cluster"]),
    "cgroup_cpu_residency_cpu_bar": _compare(_from("r_cgroup_residency_total_melt"), ["cgroup", "cpu"]),
    "task_activations_stats_count_line": _line("r_task_activations_stats_cluster", "comm, cluster", "count"),
    "task_activations_stats_duration_line": _line("r_task_activations_stats_cluster", "comm, cluster", "duration"),
    "task_activations_stats_count_bar": _activation("count"),
    "task_activations_stats_duration_bar": _activation("duration"),
    "task_activations_detailed": "SELECT * FROM r_task_activations WHERE iteration = 1 AND comm = 'RenderThread'",
    "uclamp_per_task_line": _line("r_uclamp_updates", "task, iteration, uclamp_id", x="time_it"),
    "frame_rendering_line": f"SELECT *, 1000.0 / 0.005 AS target_render_time FROM ({_line('r_fps', 'iteration', 'render_time', 'ts_iter')})",
    "frame_target_count_line": _line("r_frame_target_counts", "on_target", "count"),
    "frame_target_count_bar": _compare(_from("r_frame_target_counts"), ["on_target"], "count"),
    "capacity_line": _line("(SELECT * FROM r_capacity WHERE iteration = 1 AND cpu = 2)", "iteration, cpu", "capacity", "time_it"),
}


def _cells(view: str, name: str, where: str = "", change: bool = True) -> str:
    value = "value_label || ' (' || perc_label || ')'" if change else "value_label"
    return f"SELECT {name} AS metric, tag, {value} AS value FROM ({VIEWS[view]}) {where}"


_CELLS = [
    (0, _cells("results_bar", "metric || ' (' || test_name || ')'")),
    (1, _cells("jankbench_mean_frame_durations_bar", "variable")),
    (2, _cells("jankbench_jank_percentage_bar", "variable")),
    (3, _cells("jankbench_max_frame_durations", "variable", change=False)),
    (4, _cells("power_meter_bar", "'CPU_total_power'", "WHERE channel = 'CPU'")),
    (5, "SELECT metric, tag, CAST(percentage AS VARCHAR) || '%' AS value FROM r_overutilized_mean"),
    (6, _cells("thermal_bar", "'thermal (' || cluster || ')'")),
    (7, _cells("wakeup_latency_bar", "'latency (' || comm || ')'")),
    (8, _cells("tasks_cpu_residency_per_task_bar", "'CPU residency (' || comm || ')'", "WHERE cluster = 'total'")),
]
VIEWS["summary"] = f"""
  SELECT CAST(block AS INTEGER) AS block, metric, any_value(value) FILTER (tag = 'baseline') AS baseline,
    any_value(value) FILTER (tag = 'candidate') AS candidate
  FROM ({' UNION ALL '.join(f'SELECT {i} AS block, * FROM ({c})' for i, c in _CELLS)}) GROUP BY block, metric"""

_RUNS_ROUNDED = {"jb_mean_frame_duration": "value", "pixel6_emeter_mean": "power"}
_RUNS_SHOWN = [n for n in RUNS if n not in (
    "results_all", "emeter_means", "adpf_totals", "energy_estimate_mean", "sched_pelt_cfs_mean", "tasks_residency",
    "tasks_residency_cpu_total", "task_activations_stats_cluster", "task_activations",
)]


HOUR_NS = 3600000000000


def _printed(x: str, digits: int) -> str:
    """A number rounded as it is printed, ties away from zero."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(30, 12)), {digits}) AS DOUBLE) AS VARCHAR)"


def _human_printed(x: str) -> str:
    return f"""CASE WHEN {x} > 1e9 THEN {_printed(f'{x} / 1e9', 3)} || 'B' WHEN {x} > 1e6 THEN {_printed(f'{x} / 1e6', 3)} || 'M'
      WHEN {x} > 1e4 THEN {_printed(f'{x} / 1e3', 2)} || 'k'
      WHEN {x} <> 0 AND abs({x}) < 0.01 THEN {_printed(f'{x} * 1e6', 2)} || 'μ' ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END"""


_CHANGE = "(o_custkey / 7 - 100)"
_SIGNED = f"'(' || CASE WHEN CAST(round(CAST({_CHANGE} AS DECIMAL(30, 12)), 2) AS DOUBLE) > 0 THEN '+' ELSE '' END || {_printed(_CHANGE, 2)} || '%)'"
#: the limiting distribution, by whichever of its two series converges fast
_LIMITING = """CASE WHEN lam = 0 THEN 1.0 WHEN lam < 1.18 THEN greatest(0.0, 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 60), lambda k:
  exp(-pow((2 * k - 1) * pi() / lam, 2) / 8)))) ELSE least(1.0, 2 * list_sum(list_transform(range(1, 60), lambda k:
  (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2 * k * k * lam * lam)))) END"""
STEPS = {
    "trace_windows": "SELECT * FROM win",
    "switch_intervals": f"SELECT {KEYS}, t_ns, seq, cpu, pid, comm, t_end_ns FROM iv",
    "cluster_residency": f"SELECT {KEYS}, comm, {_cluster('cpu')} AS cluster, CAST(sum(ns) AS BIGINT) / 1e9 AS time FROM cpu_ns GROUP BY ALL",
    "power_spans": f"""
      SELECT p.wa_path, p.iteration, {_cluster('p.cpu')} AS cluster, p.cpu, p.t_ns, c.t_end_ns, CAST(power AS DOUBLE) AS power
      FROM cpu_power p JOIN chg_iv c ON p.wa_path = c.wa_path AND p.iteration = c.iteration AND p.cpu = c.cpu AND p.t_ns = c.t_ns
      WHERE power IS NOT NULL""",
    "task_names": f"SELECT DISTINCT {KEYS}, pid, comm FROM ev WHERE type <> 'signup'",
    "names_by_pid": "SELECT * FROM names",
    "cgroup_members": "SELECT * FROM member",
    "held_mean": f"""
      SELECT {KEYS}, cpu, round(sum(CAST(frequency AS DOUBLE) * held) / sum(held), 6) AS frequency FROM (
        SELECT f.wa_path, f.iteration, cpu, frequency,
          CAST(coalesce(lead(t_ns) OVER (PARTITION BY f.wa_path, f.iteration, cpu ORDER BY t_ns, seq), end_ns) - t_ns AS DOUBLE) AS held
        FROM freq f JOIN win USING ({KEYS})) GROUP BY {KEYS}, cpu""",
    "frequency_as_of": """
      SELECT s.wa_path, s.iteration, s.cpu, s.t_ns, s.pid, coalesce(f.frequency, 0) AS frequency FROM sw s ASOF LEFT JOIN freq f
      ON s.wa_path = f.wa_path AND s.iteration = f.iteration AND s.cpu = f.cpu AND s.t_ns >= f.t_ns""",
    "unique_times": f"""
      SELECT {KEYS}, seq, hour + row_number() OVER (PARTITION BY {KEYS}, hour ORDER BY seq) - 1 AS t_ns
      FROM (SELECT *, t_ns - t_ns % {HOUR_NS} AS hour FROM ev)""",
    "time_checks": f"""
      SELECT {KEYS}, min(t) AS start_ns, max(t) AS end_ns, count(*) FILTER (t IS NULL) AS without_time,
        count(*) FILTER (t < was) AS out_of_order
      FROM (SELECT *, lag(t) OVER (PARTITION BY {KEYS} ORDER BY seq) AS was FROM (
        SELECT {KEYS}, seq, CASE WHEN cents % 10 <> 0 THEN t_ns + whole * {HOUR_NS} END AS t FROM ev)) GROUP BY {KEYS}""",
    "missing_events": f"""
      SELECT {KEYS}, event FROM win, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'logout']) AS event)
      EXCEPT SELECT {KEYS}, type FROM ev WHERE whole > 150""",
    "missing_iterations": f"SELECT {KEYS} FROM win EXCEPT SELECT {KEYS} FROM ev WHERE whole > 300",
    "missing_tasks": f"""
      SELECT {KEYS}, comm FROM win, (SELECT comm FROM main_tasks UNION ALL SELECT 'decon0_kthread')
      EXCEPT SELECT {KEYS}, comm FROM sw""",
    "human_labels": f"""
      SELECT o_orderkey, {_human_printed('o_totalprice')} AS plain, {_human_printed('(o_totalprice * 1000)')} AS large,
        {_human_printed('(o_totalprice * -1000)')} AS negative, {_human_printed('(o_totalprice * 1e12)')} AS huge,
        {_human_printed('(o_custkey / 1e6)')} AS small, {_SIGNED} AS change,
        {_human_printed('o_custkey')} || ' ' || CASE WHEN o_orderkey % 10 < 2 THEN '* ' ELSE '' END || {_SIGNED} AS marked FROM orders""",
    "names": """
      SELECT c_custkey, lower(c_mktsegment) || '_k' || c_nationkey AS tag, 'wl' AS workload, '' AS no_tag, c_name || ':x' AS comm,
        lower(c_mktsegment) AS event, c_name[8:] AS perf,
        CASE c_custkey % 3 WHEN 0 THEN 'too deep' WHEN 1 THEN 'too shallow' ELSE '2' END AS miss FROM customer""",
    "price_quantiles": """
      SELECT l_returnflag, l_linestatus, CAST(q AS DOUBLE) AS quantile, round(v, 6) AS l_extendedprice FROM (
        SELECT l_returnflag, l_linestatus, unnest([0.9, 0.95, 0.99]) AS q, unnest(quantile_cont(l_extendedprice, [0.9, 0.95, 0.99])) AS v
        FROM lineitem GROUP BY l_returnflag, l_linestatus)""",
    "frame_test": f"""
      SELECT variable, 'candidate' AS tag, gap / (n * m) AS ks_d,
        round({_LIMITING}, 9) AS ks_p
      FROM (SELECT *, sqrt(CAST(n AS DOUBLE) * m / (n + m)) * gap / (CAST(n AS DOUBLE) * m) AS lam FROM (
        SELECT variable, max(abs(own * m - base * n)) AS gap, any_value(n) AS n, any_value(m) AS m FROM (
          SELECT *, sum(o) OVER (ORDER BY value) AS own, sum(b) OVER (ORDER BY value) AS base, sum(o) OVER () AS n, sum(b) OVER () AS m
          FROM (SELECT variable, value, count(*) FILTER (tag = 'candidate') AS o, count(*) FILTER (tag = 'baseline') AS b
            FROM r_jankbench WHERE variable = 'total_duration' GROUP BY ALL)) GROUP BY variable))""",
    "near_equal_test": f"""
      SELECT 'price' AS facet, 'more' AS tag, round(gap / (n * m), 9) AS ks_d, round({_LIMITING}, 9) AS ks_p
      FROM (SELECT *, sqrt(CAST(n AS DOUBLE) * m / (n + m)) * gap / (CAST(n AS DOUBLE) * m) AS lam FROM (
        SELECT CAST(max(abs(own * m - base * n)) AS DOUBLE) AS gap, any_value(n) AS n, any_value(m) AS m FROM (
          SELECT sum(o) OVER (ORDER BY value) AS own, sum(b) OVER (ORDER BY value) AS base, sum(o) OVER () AS n, sum(b) OVER () AS m
          FROM (SELECT l_extendedprice AS value, count(*) AS b,
              sum(CASE WHEN l_orderkey = (SELECT min(l_orderkey) FROM lineitem) THEN 2 ELSE 1 END) AS o FROM lineitem GROUP BY 1))))""",
    "next_run": f"""
      SELECT w.wa_path, w.iteration, w.pid, w.t_ns, CASE WHEN s.t_ns - w.t_ns <= 48 * 3600000000000 THEN s.t_ns ELSE -1 END AS ran_ns,
        CASE WHEN s.t_ns - w.t_ns <= 48 * 3600000000000 THEN s.cpu ELSE -1 END AS cpu
      FROM (SELECT * FROM ev WHERE type = 'signup') w ASOF LEFT JOIN sw s
      ON w.wa_path = s.wa_path AND w.iteration = s.iteration AND w.pid = s.pid AND w.t_ns <= s.t_ns""",
    "nearest_change": f"""
      SELECT c.wa_path, c.iteration, c.cpu, c.t_ns,
        coalesce(CASE WHEN b.t_ns IS NULL OR a.t_ns - c.t_ns < c.t_ns - b.t_ns THEN a.t_ns ELSE b.t_ns END, -1) AS change_ns,
        coalesce(CASE WHEN b.t_ns IS NULL OR a.t_ns - c.t_ns < c.t_ns - b.t_ns THEN a.frequency ELSE b.frequency END, -1) AS frequency
      FROM (SELECT * FROM ev WHERE type = 'signup') c
      ASOF LEFT JOIN freq b ON c.wa_path = b.wa_path AND c.iteration = b.iteration AND c.cpu = b.cpu AND c.t_ns >= b.t_ns
      ASOF LEFT JOIN freq a ON c.wa_path = a.wa_path AND c.iteration = a.iteration AND c.cpu = a.cpu AND c.t_ns <= a.t_ns""",
    "overlapping_runs": f"""
      SELECT l.wa_path, l.iteration, l.cluster, l.seq, r.seq AS other, least(l.till, r.till) - greatest(l.t_ns, r.t_ns) AS overlap
      FROM (SELECT *, {_cluster('cpu')} AS cluster, t_end_ns + 6 * 3600000000000 AS till FROM iv WHERE comm = 'RenderThread') l
      JOIN (SELECT *, {_cluster('cpu')} AS cluster, t_end_ns + 6 * 3600000000000 AS till FROM iv WHERE comm = 'GameThread') r
      ON l.wa_path = r.wa_path AND l.iteration = r.iteration AND l.cluster = r.cluster AND l.t_ns < r.till AND r.t_ns < l.till""",
    "burst_intervals": f"""
      SELECT {KEYS}, cpu, t_ns, coalesce(lead(t_ns) OVER (PARTITION BY {KEYS}, cpu ORDER BY t_ns, seq), max(t_ns) OVER (PARTITION BY {KEYS})) AS t_end_ns, seq
      FROM (SELECT {KEYS}, cpu, seq, CASE WHEN seq % 10 <> 0 THEN began + (t_ns - began) // 100 ELSE t_ns END AS t_ns
        FROM (SELECT ev.*, epoch_us(date_trunc('day', ts) - to_days(CAST((day(ts) - 1) % 3 AS INTEGER))) * 1000 AS began FROM ev JOIN events ON seq = event_id))""",
    "null_keys": """
      SELECT flag, l_linestatus, l_orderkey, line, coalesce(lead(l_orderkey) OVER w, -1) AS next_order, CAST(sum(line) OVER w AS BIGINT) AS upto,
        CAST(row_number() OVER w AS INTEGER) AS row
      FROM (SELECT DISTINCT nullif(l_returnflag, 'A') AS flag, l_linestatus, l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)
      WINDOW w AS (PARTITION BY flag, l_linestatus ORDER BY l_orderkey, line)""",
    "nan_values": """
      SELECT l_returnflag, CASE WHEN isnan(v) THEN 'NaN' WHEN isinf(v) THEN CASE WHEN v > 0 THEN 'inf' ELSE '-inf' END
          ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS v,
        round(sum(c) OVER (PARTITION BY l_returnflag ORDER BY v) / sum(c) OVER (PARTITION BY l_returnflag), 6) AS ecdf
      FROM (SELECT l_returnflag, v, count(*) AS c FROM (SELECT l_returnflag,
        CASE l_linenumber WHEN 7 THEN CAST('NaN' AS DOUBLE) WHEN 6 THEN CAST('inf' AS DOUBLE) WHEN 5 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity END AS v
        FROM lineitem) GROUP BY ALL)""",
    "own_statistics": """
      SELECT tag, metric, test_name, count(*) AS n, round(CASE WHEN count(*) > 2 THEN (sum(value) - min(value) - max(value)) / (count(*) - 2) END, 6) AS trimmed,
        round(max(value) - min(value), 6) AS spread, round(max(value), 6) AS largest
      FROM r_results WHERE metric IN ('jank_p', 'mean') GROUP BY ALL""",
    "merged_statistics": """
      SELECT l_returnflag, l_linestatus, round(count(*) FILTER (l_extendedprice > 50000) / count(*), 6) AS above FROM lineitem GROUP BY ALL""",
    "value_statistics": """
      SELECT pid, count(*) AS n, round(CASE WHEN min(v) = max(v) THEN min(v) WHEN min(v) = 0 THEN 0 ELSE exp(avg(CASE WHEN v > 0 THEN ln(v) END)) END, 6) AS gmean,
        round(stddev_samp(v), 6) AS std, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem
      FROM (SELECT pid, CAST(whole AS DOUBLE) AS v FROM ev) GROUP BY pid""",
}


def all_queries() -> dict[str, str]:
    sql = {name: with_parts(body) for name, body in DATASETS.items()}
    for name in _RUNS_SHOWN:
        column = _RUNS_ROUNDED.get(name)
        body = _rounded(f"r_{name}", column) if column else f"SELECT * FROM r_{name}"
        sql[f"runs_{name}"] = with_parts(body)
    for name, body in VIEWS.items():
        sql[f"view_{name}"] = with_parts(f"SELECT * FROM ({body.strip()})")
    # the same rows from the event store
    sql |= {f"store_{name}": sql[name] for name in (
        "tasks_residency_total", "idle_residency", "freqs_residency", "energy_estimate_mean", "overutilized", "perf_counters", "wakeup_latency", "task_activations")}
    sql |= {f"step_{name}": with_parts(body) for name, body in STEPS.items()}
    return sql
