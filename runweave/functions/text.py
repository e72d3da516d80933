"""Names, labels and formatted numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "<unknown>"
SIGNIFICANT = 0.02
PERF_PREFIX = 7  # fixed value: characters of the prefix that marks a perf result


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_tag(wa_path: str) -> Column:
    """The tag in ``<workload>_<tag>_<iterations>_<date>``; it may hold underscores, or be empty."""
    parts = f"split({wa_path}, '_')"
    return F.expr(f"array_join(slice({parts}, 2, greatest(size({parts}) - 3, 0)), '_')")


def run_workload(wa_path: str) -> Column:
    return F.expr(f"split({wa_path}, '_')[0]")


def tag_order(tag: str | Column, tags: list[str]) -> Column:
    """Position of a tag in the list of runs, from 0; null for a tag that is not in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in tags]), _col(tag)), F.lit(0)) - 1


def event_name(file_name: str | Column) -> Column:
    """Event of a file: the name up to its first dot, without the ``lisa__`` prefix."""
    return F.regexp_replace(F.substring_index(_col(file_name), ".", 1), "^lisa__", "")


def task_comm(label: str | Column) -> Column:
    """The name in ``[pid:name]``; colons in the name stay."""
    return F.regexp_extract(_col(label), r"^\[[^:]*:(.*)\]$", 1)


def perf_name(metric: str | Column) -> Column:
    return F.expr(f"substring({metric}, {PERF_PREFIX + 1})") if isinstance(metric, str) else F.substring(metric, F.lit(PERF_PREFIX + 1), F.length(metric))


def miss_type(below: str | Column) -> Column:
    below = _col(below)
    return F.when(below == 0, "too deep").when(below == 1, "too shallow").otherwise(below.cast("string"))


# The functions below take the text of a numeric expression.

def _text(x: str) -> str:
    """A double without exponent: its own text, or decimals with at least one place."""
    decimals = f"try_cast({x} as decimal(38, 12))"
    trimmed = f"regexp_replace(regexp_replace(cast({decimals} as string), '0+$', ''), '[.]$', '.0')"
    return f"if(cast({x} as string) like '%E%', coalesce({trimmed}, cast({x} as string)), cast({x} as string))"


def _human(x: str) -> str:
    return f"""case
        when {x} > 1e9D then concat({_text(f"round({x} / 1e9D, 3)")}, 'B')
        when {x} > 1e6D then concat({_text(f"round({x} / 1e6D, 3)")}, 'M')
        when {x} > 1e4D then concat({_text(f"round({x} / 1e3D, 2)")}, 'k')
        when {x} != 0 and abs({x}) < 0.01D then concat({_text(f"round({x} * 1e6D, 2)")}, 'μ')
        else {_text(x)} end"""


def _signed(x: str) -> str:
    rounded = f"round(cast({x} as double), 2)"
    return f"concat('(', if({rounded} > 0, '+', ''), {_text(rounded)}, '%)')"


def human_number(x: str) -> Column:
    """A number shortened for a label: billions ``B``, millions ``M``, above ten thousand ``k``, tiny ``μ``."""
    return F.expr(_human(f"cast({x} as double)"))


def percent(x: str) -> Column:
    return F.expr(f"concat({_text(f'round(cast({x} as double), 2)')}, '%')")


def signed_percent(x: str) -> Column:
    """``(+1.5%)``, ``(-1.5%)`` or ``(0.0%)``."""
    return F.expr(_signed(x))


def marked_change(value: str, change: str, p_value: str, below: float = SIGNIFICANT) -> Column:
    """Value with its signed change, starred when the test finds the runs different.

    Without a change (there is none from 0) it is the value alone.
    """
    star = f"if(coalesce({p_value} < {below}, false), '* ', '')"
    return F.expr(f"concat({_human(f'cast({value} as double)')}, coalesce(concat(' ', {star}, {_signed(change)}), ''))")
