"""The transaction log as the feature blocks read it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import with_neighbours
from tidemark.sources.tables import table

#: Columns made from a line, in words that both engines know. ``w`` and ``a`` are net and gross amount
#: floored at 0, ``good`` the code in 13 digits, ``code`` the
#: same with a code of its own for none, ``txt`` the category names in one string.
DERIVED = {
    "d": "cast(ts as date)",
    "h": "hour(ts)",
    "hm": "hour(ts) * 100 + minute(ts)",
    "mon": "month(ts)",
    "dom": "day(ts)",
    "w": "greatest(coalesce(net_amt, 0), 0)",
    "a": "greatest(coalesce(tot_amt, 0), 0)",
    "good": "case when trim(goodcd) = '' then null when length(trim(goodcd)) < 13 then lpad(trim(goodcd), 13, '0') else trim(goodcd) end",
    "code": "coalesce(case when trim(goodcd) = '' then null when length(trim(goodcd)) < 13 then lpad(trim(goodcd), 13, '0') else trim(goodcd) end, '0000000000nan')",
    "brand": "nullif(upper(trim(brd_nm)), '')",
    "txt": "concat(coalesce(part_nm, ''), ' ', coalesce(pc_nm, ''), ' ', coalesce(corner_nm, ''))",
    "net": "case when coalesce(net_amt, 0) <> 0 then net_amt else tot_amt end",
}
RAW = ["line_id", "custid", "str_nm", "goodcd", "brd_nm", "corner_nm", "pc_nm", "part_nm", "team_nm", "buyer_nm", "import_flg", "tot_amt", "dis_amt", "net_amt", "inst_mon"]


def needed(text: str) -> list[str]:
    """The columns of the log that the words of ``text`` name, directly or through ``DERIVED`` ones."""
    words, seen = set(re.findall(r"[A-Za-z_]\w*", text)), set()
    while words - seen:
        new = words - seen
        seen |= new
        words |= {w for n in new if n in DERIVED for w in re.findall(r"[A-Za-z_]\w*", DERIVED[n])}
    return [c for c in RAW if c in words]


#: Columns of which kept lines may have the value of the customer's line before, as ``prev_<c>``.
PREVIOUS = ("ts", "buyer_nm", "corner_nm", "net", "code")
#: What ``placed`` adds.
PLACES = ["pos", "pos_back", "n_rows", *[f"prev_{c}" for c in PREVIOUS], "has_prev"]


def placed(lines: DataFrame) -> DataFrame:
    """Lines with their place among the customer's and the line before, for all that need them."""
    return with_neighbours(lines, "custid", "d", ["ts", "line_id"], PREVIOUS)


_HELD: dict[tuple[str, str, str], DataFrame] = {}


@contextmanager
def held_lines(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Iterator[None]:
    """Within it, ``sales`` gives the kept lines of these tables and reads and shuffles none of them again."""
    keys = {(spark.sparkContext.applicationId, folder, t): df for t, df in tables.items()}
    before = {k: _HELD[k] for k in keys if k in _HELD}
    _HELD.update(keys)
    try:
        yield
    finally:
        for k in keys:
            del _HELD[k]
        _HELD.update(before)


def sales(spark: SparkSession, folder: str, name: str = "train_transactions", uses: str | None = None) -> DataFrame:
    """Lines with custid and time, each once, with the ``DERIVED`` columns and ``dow`` (Monday 0). ``uses``
    names the columns that are wanted, in any text; the others are neither read nor shuffled.

    Rows are partitioned by (custid, day), the one shuffle of raw rows in a block: a line's deliveries
    meet there, day-level sums and windows need no other, and a hot custid is spread over its days. A
    line delivered again is equal in all columns; lines without a line_id count each.
    """
    if (kept := _HELD.get((spark.sparkContext.applicationId, folder, name))) is not None:
        return kept
    raw = RAW if uses is None else ["line_id", "custid", *[c for c in needed(uses) if c not in ("line_id", "custid")]]
    rows = table(spark, folder, name).where("custid is not null and sales_datetime is not null")
    alone = F.when(F.col("line_id").isNull(), F.monotonically_increasing_id())
    rows = rows.select(*raw, F.col("sales_datetime").alias("ts"), F.to_date("sales_datetime").alias("d"), alone.alias("__alone"))
    once = rows.repartition("custid", "d").distinct().drop("__alone")
    have = set(once.columns)
    made = {c: e for c, e in DERIVED.items() if c != "d" and set(needed(e)) <= have}
    return once.selectExpr("*", "weekday(ts) as dow", *[f"{e} as {c}" for c, e in made.items()])


def sales_sql(name: str = "train_transactions", alias: str = "s") -> str:
    """The same, with all columns, as a common table expression."""
    cols = ", ".join(RAW)
    made = ", ".join(f"{e} as {c}" for c, e in DERIVED.items())
    rows = f"{cols}, sales_datetime AS ts FROM {name} WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL AND line_id IS"
    return f"{alias} AS (SELECT *, isodow(ts) - 1 AS dow, {made} FROM (SELECT DISTINCT {rows} NOT NULL UNION ALL SELECT {rows} NULL))"
