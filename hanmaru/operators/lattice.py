"""A tokenizer over a dictionary: the cheapest paths through each clause's lattice of words.

words(form, tag, cost) may be of any size: every stretch of a clause that is short enough to be a word meets them in an
equi-join, as prefix lookups do, and nothing is sent out. A clause's words then meet in one row, which is bounded by the
clause's length times the longest word's; there the cheapest paths to each place are kept, a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import TOP_TOKENIZATIONS

#: Tag and cost of a character that no word covers.
UNKNOWN, UNKNOWN_COST = "un", 1_000
TOKENS = "array<struct<form:string,tag:string,position:int,length:int>>"
Path = tuple[int, str, tuple]


def edges(clauses: DataFrame, words: DataFrame) -> DataFrame:
    """(clause_id, at, form, tag, cost) of every word at every place of clauses (clause_id, text), in code points from 0, and of
    every single character as an unknown word. A word that the dictionary names twice with one tag costs the less."""
    known = words.where(F.length("form") > 0).groupBy("form", "tag").agg(F.min("cost").cast("long").alias("cost"))
    longest = known.agg(F.max(F.length("form"))).first()[0] or 0
    places = clauses.where(F.length("text") > 0).select("clause_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("at"))
    rest = F.least(F.lit(longest), F.length("text") - F.col("at"))
    stretches = places.where(rest > 0).select("clause_id", "at", F.explode(F.transform(F.sequence(F.lit(1), rest), lambda n: F.substring("text", F.col("at") + 1, n))).alias("form"))
    single = places.select("clause_id", "at", F.substring("text", F.col("at") + 1, F.lit(1)).alias("form"), F.lit(UNKNOWN).alias("tag"), F.lit(UNKNOWN_COST).cast("long").alias("cost"))
    return stretches.join(known, "form").select("clause_id", "at", "form", "tag", "cost").unionByName(single)


def cheapest(found: list[tuple[int, str, str, int]], k: int) -> list[Path]:
    """The k cheapest paths (cost, name, tokens) through words (at, form, tag, cost), ties by name, the forms and tags in order."""
    by_place: dict[int, list] = {}
    for at, form, tag, cost in found:
        by_place.setdefault(at, []).append((form, tag, cost))
    best: dict[int, list[Path]] = {0: [(0, "", ())]}
    for at in sorted(by_place):
        paths = best.pop(at, [])
        for form, tag, cost in by_place[at]:
            to = best.setdefault(at + len(form), [])
            for total, name, tokens in paths:
                to.append((total + cost, f"{name}|{form}/{tag}" if name else f"{form}/{tag}", (*tokens, (form, tag))))
            to.sort(key=lambda p: p[:2])
            del to[k:]
    return best[max(best)] if by_place else []


def tokenizations(clauses: DataFrame, words: DataFrame, k: int = TOP_TOKENIZATIONS) -> DataFrame:
    """tokenizations(clause_id, result_rank, score, tokens) for `segments`, whose positions are UTF-16 units: the k cheapest ways to
    read each clause; score is the cost, taken negative. Clauses without text have none."""
    clause = clauses.schema["clause_id"].dataType.simpleString()
    lattice = edges(clauses, words).groupBy("clause_id").agg(F.collect_list(F.struct("at", "form", "tag", "cost")).alias("words"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for clause_id, found in zip(frame["clause_id"], frame["words"], strict=True):
                for rank, (cost, _, path) in enumerate(cheapest([(w["at"], w["form"], w["tag"], w["cost"]) for w in found], k)):
                    tokens, at = [], 0
                    for form, tag in path:
                        size = len(form.encode("utf-16-le")) // 2
                        tokens.append({"form": form, "tag": tag, "position": at, "length": size})
                        at += size
                    out.append((clause_id, rank, -float(cost), tokens))
            yield pd.DataFrame(out, columns=["clause_id", "result_rank", "score", "tokens"])

    return lattice.mapInPandas(run, f"clause_id {clause}, result_rank int, score double, tokens {TOKENS}")
