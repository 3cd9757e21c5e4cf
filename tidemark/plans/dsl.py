"""Feature blocks as steps, each of which is a DataFrame operation here and a SQL clause for the oracle.

Expressions are SQL that both engines read; what they spell differently stands in braces:
``{pct x;q}``, ``{skew x}`` (sample-corrected), ``{skew_pop x}``, ``{kurt x}`` (population, excess),
``{like x;pattern}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import with_position, with_previous
from tidemark.operators.quantile import group_quantiles, quantiles
from tidemark.operators.rank import running_counts
from tidemark.sources.sales import PLACES, sales, sales_sql

_SPARK = {
    "pct": "percentile({0}, {1})",
    "skew": "case when count({0}) > 2 then skewness({0}) * sqrt(count({0}) * (count({0}) - 1)) / (count({0}) - 2) end",
    "skew_pop": "skewness({0})",
    "kurt": "kurtosis({0})",
    "like": "rlike({0}, '{1}')",
    "days": "datediff({0}, {1})",
    "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})",
}
_DUCK = {
    "pct": "quantile_cont({0}, {1})",
    "skew": "case when count({0}) > 2 then skewness({0}) end",
    "skew_pop": "(skewness({0}) * (count({0}) - 2) / sqrt(count({0}) * (count({0}) - 1)))",
    "kurt": "kurtosis_pop({0})",
    "like": "regexp_matches({0}, '{1}')",
    "days": "date_diff('day', {1}, {0})",
    "us": "epoch_us({0})",
}


def _spell(text: str, words: dict[str, str]) -> str:
    def one(m: re.Match) -> str:
        return words[m.group(1)].format(*[x.strip() for x in m.group(2).split(";")])

    return re.sub(r"\{(\w+) ([^{}]*)\}", one, text)


def spark_sql(text: str) -> str:
    return _spell(text, _SPARK)


def duck_sql(text: str) -> str:
    return _spell(text, _DUCK)


@dataclass
class Block:
    """Steps from the lines of a sales table to one row per custid (or other keys)."""

    steps: list[tuple] = field(default_factory=list)
    tables: list[str] = field(default_factory=lambda: ["train_transactions"])

    def _add(self, *step) -> Block:
        return Block([*self.steps, step], self.tables)

    def cols(self, **exprs: str) -> Block:
        return self._add("cols", exprs)

    def where(self, cond: str) -> Block:
        return self._add("where", cond)

    def agg(self, keys: str, **exprs: str) -> Block:
        return self._add("agg", keys.split(), exprs)

    def out(self, digits: int = 6, **exprs: str) -> Block:
        """The last projection: custid and the expressions, rounded. The tiny addend keeps halves of the
        last digit, which engines round apart, and negative zeros out."""
        return self._add("out", {"custid": "custid", **{k: f"round(cast({e} as double) + 1e-10, {digits})" for k, e in exprs.items()}})

    def previous(self, *columns: str) -> Block:
        """``prev_<c>`` and ``has_prev`` in the custid's order of time and line."""
        return self._add("previous", columns)

    def position(self) -> Block:
        """``pos``, ``pos_back`` and ``n_rows`` in that order."""
        return self._add("position")

    def totals(self, keys: str, **exprs: str) -> Block:
        """Adds sums over ``keys`` to every row, by an aggregate joined back. Null keys get null."""
        return self._add("totals", keys.split(), exprs)

    def overall(self, **exprs: str) -> Block:
        """Adds aggregates over all rows, one row, to every row."""
        return self._add("overall", exprs)

    def relative(self, key: str, value: str, name: str) -> Block:
        """``name``: average rank of ``value`` among the rows of the same ``key``, over their number."""
        return self._add("relative", key, value, name)

    def gap(self) -> Block:
        """From a row per custid and day: ``gap``, the days since the custid's day before."""
        return self._add("gap")

    def placed(self, value: str) -> Block:
        """From a row per custid and group: ``place``, the group's average rank by ``value`` from the top."""
        return self._add("placed", value)

    def first_last(self, column: str) -> Block:
        """A row per custid and day with the column in its first and its last line."""
        return self._add("first_last", column)

    def spine(self) -> Block:
        """The last step: every custid of the lines has a row, with 0 where there was none or null."""
        return self._add("spine")

    def select(self, **exprs: str) -> Block:
        return self._add("out", exprs)

    def uses(self) -> str:
        """All words of the steps, among them the columns of the log that they need."""
        return " ".join(f"{k} {v}" if isinstance(x, dict) else str(x) for step in self.steps for x in step for k, v in (x.items() if isinstance(x, dict) else [(x, "")]))

    def spark(self, session: SparkSession, folder: str) -> DataFrame:
        df = None
        for t in self.tables:
            part = sales(session, folder, t, self.uses())
            df = part if df is None else df.unionByName(part)
        return self.over(df)

    def over(self, df: DataFrame) -> DataFrame:
        """The block over lines as ``sales`` gives them."""
        lines, whole = df, True
        for i, step in enumerate(self.steps):
            if step[0] in ("previous", "position"):
                new = ["pos"] if step[0] == "position" else [f"prev_{c}" for c in step[1]]
                if whole and set(new) <= set(df.columns):
                    continue  # the lines were kept with it
                df = df.drop(*PLACES)
            whole = whole and step[0] == "cols"
            if step[0] == "relative":
                # ranks of steps in a row are all counted over the rows before them
                first = i == 0 or self.steps[i - 1][0] != "relative"
                source = df if first else source
                df = _relative(df, *step[1:], source)
                continue
            df = _spine(df, lines) if step[0] == "spine" else _APPLY[step[0]](df, *step[1:])
        return df

    def _spine_sql(self, n: int) -> str:
        names = [c for c in self.steps[n - 1][1] if c != "custid"]
        return f"t{n + 1} AS (SELECT custid, {', '.join(f'coalesce({c}, 0) AS {c}' for c in names)} FROM (SELECT DISTINCT custid FROM t0) LEFT JOIN t{n} USING (custid))"

    def sql(self) -> str:
        parts = [sales_sql(t, f"s{i}") for i, t in enumerate(self.tables)]
        parts.append("t0 AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(self.tables))) + ")")
        n = 0
        for step in self.steps:
            parts.append(f"t{n + 1} AS ({_WRITE[step[0]](f't{n}', *step[1:])})" if step[0] != "spine" else self._spine_sql(n))
            n += 1
        return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM t{n}"


def _exprs(exprs: dict[str, str]) -> list:
    return [F.expr(spark_sql(e)).alias(k) for k, e in exprs.items()]


def as_sets(text: str) -> str:
    """``count(distinct x)`` as the size of a set. Several distinct counts in one aggregate otherwise copy
    every row for each of them; a customer's set is no larger than the column has values."""
    word = "count(distinct "
    while (at := text.find(word)) >= 0:
        depth, end = 1, at + len(word)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}size(collect_set({text[at + len(word) : end - 1]})){text[end:]}"
    return text


def _agg(df: DataFrame, keys: list[str], exprs: dict[str, str]) -> DataFrame:
    if "custid" in keys:  # other keys may have as many customers as there are
        exprs = {k: as_sets(e) for k, e in exprs.items()}
    held = {}
    if "ts" in df.columns:  # over lines, a key's values aren't gathered in one buffer
        for name, e in exprs.items():
            if m := re.fullmatch(r"\{pct (\w+);([0-9.]+)\}|median\((\w+)\)", e):
                held[name] = (m.group(3) or m.group(1), float(m.group(2) or 0.5))
    plain = df.groupBy(*keys).agg(*_exprs({k: e for k, e in exprs.items() if k not in held} or {"__n": "count(*)"}))
    if not held:
        return plain
    return plain.join(group_quantiles(df, keys, held, ["custid", "d"]), keys, "left").select(*keys, *exprs)


def _totals(df: DataFrame, keys: list[str], exprs: dict[str, str]) -> DataFrame:
    if keys == ["custid"] and "ts" in df.columns:
        # lines meet their customer's totals day by day, where they lie already
        side = df.groupBy(F.col("custid").alias("__c")).agg(*_exprs(exprs))
        days = df.select(F.col("custid").alias("__custid"), F.col("d").alias("__d")).distinct().join(side, F.col("__custid") == F.col("__c")).drop("__c")
        return df.join(days, (F.col("custid") == F.col("__custid")) & (F.col("d") == F.col("__d"))).drop("__custid", "__d")
    side = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*_exprs(exprs))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"__{k}")
        cond = c if cond is None else cond & c
    return df.join(side, cond, "left").drop(*[f"__{k}" for k in keys])


def _relative(df: DataFrame, key: str, value: str, name: str, source: DataFrame) -> DataFrame:
    # a key's rows are counted by value first, and the counts summed in ranges of values
    own = source.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    ranks = running_counts(own, ["__k"], "__v").select("__k", "__v", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("total")).alias(name))
    return df.join(ranks, (F.col(key) == F.col("__k")) & (F.col(value) == F.col("__v")), "left").drop("__k", "__v")


# groups and days of a custid are few, whatever its lines
def _gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", F.datediff("d", F.lag("d").over(W.partitionBy("custid").orderBy("d"))))


def _placed(df: DataFrame, value: str) -> DataFrame:
    w = W.partitionBy("custid")
    ties = F.count("*").over(W.partitionBy("custid", value))
    return df.withColumn("place", F.rank().over(w.orderBy(F.desc(value))) + (ties - 1) / 2)


def _first_last(df: DataFrame, column: str) -> DataFrame:
    at = F.struct("ts", "line_id")
    return df.groupBy("custid", "d").agg(F.min_by(column, at).alias(f"first_{column}"), F.max_by(column, at).alias(f"last_{column}"))


def _spine(df: DataFrame, lines: DataFrame) -> DataFrame:
    ids = lines.select("custid").distinct()
    return ids.join(df, "custid", "left").select("custid", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in df.columns if c != "custid"])


def _overall(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Quantiles come as numbers, from a column that may have any number of values; the rest as one row."""
    plain = {}
    for name, e in exprs.items():
        if m := re.fullmatch(r"\{pct (\w+);([0-9.]+)\}", e):
            df = df.withColumn(name, F.lit(quantiles(df, m.group(1), [float(m.group(2))])[0]).cast("double"))
        else:
            plain[name] = e
    return df.crossJoin(F.broadcast(df.agg(*_exprs(plain)))) if plain else df


_APPLY: dict[str, Callable] = {
    "cols": lambda df, e: df.selectExpr("*", *[f"{spark_sql(x)} as {k}" for k, x in e.items()]),
    "out": lambda df, e: df.select(*_exprs(e)),
    "where": lambda df, c: df.where(spark_sql(c)),
    "agg": _agg,
    "previous": lambda df, c: with_previous(df, "custid", "d", ["ts", "line_id"], list(c)),
    "position": lambda df: with_position(df, "custid", "d", ["ts", "line_id"]),
    "totals": _totals,
    "overall": _overall,
    "gap": _gap,
    "placed": _placed,
    "first_last": _first_last,
}

_ORDER = "PARTITION BY custid ORDER BY ts, line_id"


def _pairs(e: dict[str, str]) -> str:
    return ", ".join(f"{duck_sql(x)} AS {k}" for k, x in e.items())


_WRITE: dict[str, Callable] = {
    "cols": lambda t, e: f"SELECT *, {_pairs(e)} FROM {t}",
    "out": lambda t, e: f"SELECT {_pairs(e)} FROM {t}",
    "where": lambda t, c: f"SELECT * FROM {t} WHERE {duck_sql(c)}",
    "agg": lambda t, k, e: f"SELECT {', '.join([*k, _pairs(e)])} FROM {t}" + (f" GROUP BY {', '.join(k)}" if k else ""),
    "previous": lambda t, c: f"SELECT *, {', '.join(f'lag({x}) OVER ({_ORDER}) AS prev_{x}' for x in c)}, row_number() OVER ({_ORDER}) > 1 AS has_prev FROM {t}",
    "position": lambda t: f"SELECT *, row_number() OVER ({_ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY custid) - row_number() OVER ({_ORDER}) AS pos_back, count(*) OVER (PARTITION BY custid) AS n_rows FROM {t}",
    "totals": lambda t, k, e: f"SELECT {t}.*, {', '.join(f'g.{x}' for x in e)} FROM {t} LEFT JOIN (SELECT {', '.join(k)}, {_pairs(e)} FROM {t} GROUP BY {', '.join(k)}) g USING ({', '.join(k)})",
    "overall": lambda t, e: f"SELECT * FROM {t}, (SELECT {_pairs(e)} FROM {t})",
    "relative": lambda t, k, v, n: f"SELECT *, CASE WHEN {k} IS NOT NULL AND {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {k}) END AS {n} FROM {t}",
    "gap": lambda t: f"SELECT *, date_diff('day', lag(d) OVER (PARTITION BY custid ORDER BY d), d) AS gap FROM {t}",
    "placed": lambda t, v: f"SELECT *, rank() OVER (PARTITION BY custid ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY custid, {v}) - 1) / 2.0 AS place FROM {t}",
    "first_last": lambda t, c: f"SELECT custid, d, first({c} ORDER BY ts, line_id) AS first_{c}, last({c} ORDER BY ts, line_id) AS last_{c} FROM {t} GROUP BY custid, d",
}
