"""URL rules as a sort-merge range join on reversed hosts.

With its labels reversed (``com.example.www.``) a host sorts behind every domain it belongs to, so the subdomains of a
rule's host are one interval of keys, and two such intervals are nested or apart. Urls and rules are dealt out by cut
points of (key, url hash), which splits a host of any size; a rule goes to each part that its interval meets. A part is
sorted, and one sweep keeps a stack of the rules whose interval is open. Of the open rules whose path starts the url's
path the longest wins; at equal length the longer host, then ``block``.

Edge cases: a url that is NULL or has no ``://`` has an empty host and path, and no rule fits it. Repeated rules count
once; of equal rules with different verdicts ``block`` wins. Without rules every url gets the default verdict. A rule
that is NULL or has an empty host fits nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strayfield.llm.common import fresh
from strayfield.session import parallelism

PART_ROWS = 100_000  # urls that a part of the sweep holds, about
PER_PART = 32  # sampled keys for each part
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(name: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; empty for no host."""
    return F.when(name == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit(".")))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of several parts in, the winning rule of each url out. The stack holds open rules by host."""
    part, stack = None, []  # (key, host, {path: verdict}, path lengths)
    for batch in batches:
        won, verdicts = [], []
        is_rule = batch["rule_verdict"].notna().to_numpy()
        for p, key, h, q, verdict, rule in zip(batch["part"], batch["key"], batch["host"], batch["path"], batch["rule_verdict"], is_rule):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule:
                if not stack or stack[-1][0] != key:
                    stack.append((key, h, {}, []))
                paths, lengths = stack[-1][2:]
                if paths.get(q) != "block":
                    paths[q] = verdict
                if len(q) not in lengths:
                    lengths.append(len(q))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, of, paths, lengths in stack:
                for n in lengths:
                    if n <= len(q) and q[:n] in paths:
                        if best is None or len(of) + n >= best[0]:
                            best = len(of) + n, of + q[:n], paths[q[:n]]
                        break
            won.append(best and best[1])
            verdicts.append(best and best[2])
        out = batch.loc[~is_rule, ["row", "host", "path"]].copy()
        out["rule"], out["verdict"] = pd.Series(won, out.index, dtype=object), pd.Series(verdicts, out.index, dtype=object)
        yield out


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = DEFAULT) -> DataFrame:
    """The columns ``keep`` of ``urls`` (all, if not given) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). Both tables are shuffled once, by part.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in (keep or urls.columns) if c.lower() not in new]
    spark = urls.sparkSession
    rows = urls.count()
    parts = max(2 * parallelism(spark), rows // PART_ROWS)
    every = max(1, rows // (parts * PER_PART))
    (tie,) = fresh(urls, "tie")
    at = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"), F.xxhash64(*[F.col(f"`{c}`") for c in urls.columns]).alias(tie)
    ).withColumn("key", reversed_key(F.col("host")))
    # the driver sees a fixed number of keys per part, as in any range partitioning
    sample = [tuple(r) for r in at.where(F.pmod(F.col(tie), F.lit(every)) == 0).select("key", tie).sort("key", tie).collect()]
    cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    low = (float("-inf"),)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in zip(key, h)])

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(cuts, (k, *low)), bisect_right(cuts, (k + LAST, *low)) + 1)) for k in key])

    marked = at.select(part_of("key", tie).alias("part"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("rule_verdict"))
    real = rules.select("host", "path", "verdict").where("host is not null and host <> '' and path is not null and verdict is not null").distinct()
    real = real.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("key", reversed_key(F.col("host")))
    spread = real.withColumn("part", F.explode(parts_of("key")))
    opened = spread.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast(marked.schema["row"].dataType).alias("row"), "host", "path", F.col("verdict").alias("rule_verdict"))
    sorted_rows = marked.unionByName(opened).repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "kind")
    kind = marked.schema["row"].dataType
    out = sorted_rows.mapInPandas(sweep, f"row {kind.simpleString()}, host string, path string, rule string, verdict string")
    return out.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
