"""Monotone alignment of two token sequences of one verse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_pair(keys: list[str | None], base: list[str | None]) -> list[tuple[int, str]]:
    """For each key the index in ``base`` it aligns with (-1: none) and the pass that found it.

    Pass 1 takes equal keys at the same index. Pass 2 takes, for each key left over, the first unused equal key at or
    after a cursor that only moves forward. Empty keys never match.
    """
    got = [-1] * len(keys)
    how = ["none"] * len(keys)
    used = [False] * len(base)
    for i, (a, b) in enumerate(zip(keys, base)):
        if a and a == b:
            got[i], how[i], used[i] = i, "place", True
    cursor = 0
    for i, a in enumerate(keys):
        if got[i] >= 0 or not a:
            continue
        j = next((j for j in range(cursor, len(base)) if not used[j] and base[j] == a), -1)
        if j >= 0:
            got[i], how[i], used[j], cursor = j, "order", True, j + 1
    return list(zip(got, how))


def align_tokens(left: DataFrame, right: DataFrame, verse: list[str], witness: str) -> DataFrame:
    """``left`` (witness, verse keys, position, id, key) against ``right`` (the same keys, base_position, base_id, base_key).

    Grouped by witness and verse: a verse holds tens of tokens whatever the corpus size, so no group grows with the
    data. The tokens of both sides are nested per verse and joined once.
    """
    b = right.groupBy(witness, *verse).agg(F.array_sort(F.collect_list(F.struct("base_position", "base_id", "base_key"))).alias("base"))
    a = left.groupBy(witness, *verse).agg(F.array_sort(F.collect_list(F.struct("position", "id", "key"))).alias("toks")).join(b, [witness, *verse], "left")

    @F.pandas_udf("array<struct<id:string,base_id:string,how:string>>")
    def run(toks: pd.Series, base: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(toks, base):
            s = [] if s is None else list(s)
            m = align_pair([x["key"] for x in t], [x["base_key"] for x in s])
            out.append([{"id": x["id"], "base_id": s[j]["base_id"] if j >= 0 else None, "how": h} for x, (j, h) in zip(t, m)])
        return pd.Series(out)

    return a.select(witness, *verse, F.explode(run("toks", "base")).alias("m")).select(witness, *verse, "m.id", "m.base_id", "m.how")
