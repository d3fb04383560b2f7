"""Cover density: how closely the terms of a request stand together in a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cover_score(places: Column | str) -> Column:
    """STRUCT<covers, score> from places ARRAY<ARRAY<INT>>: where each term of a request stands in a chunk.

    A cover is a shortest stretch with all terms (Clarke, Cormack and Tudhope, Relevance ranking for one to three term queries);
    it adds 1 / (1 + its places that match no term). Equality with the rank function of any database is unverified. One pass over
    the occurrences in order: the last place of each term is kept, the least of them begins the shortest stretch that ends here,
    and it is new if it lies behind the last one's. What a stretch holds of other places follows from the occurrences' numbers.
    A term that stands nowhere leaves no cover, and so do no terms."""
    column = F.col(places) if isinstance(places, str) else places
    each = F.array_sort(F.flatten(F.transform(column, lambda of_term, k: F.transform(of_term, lambda p: F.struct(p.cast("long").alias("place"), k.cast("int").alias("term"))))))
    never = F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("number"))
    start = F.struct(F.transform(column, lambda _: never).alias("last"), F.lit(0).cast("long").alias("number"), F.lit(-1).cast("long").alias("before"), F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("score"))

    def step(state: Column, x: Column) -> Column:
        number = state["number"] + 1
        last = F.transform(state["last"], lambda old, k: F.when(k == x["term"], F.struct(x["place"].alias("place"), number.alias("number"))).otherwise(old))
        low = F.array_min(last)
        new = (low["place"] >= 0) & (low["place"] > state["before"])
        others = (x["place"] - low["place"] + 1) - (number - low["number"] + 1)
        return F.struct(
            last.alias("last"),
            number.alias("number"),
            F.when(new, low["place"]).otherwise(state["before"]).alias("before"),
            F.when(new, state["covers"] + 1).otherwise(state["covers"]).alias("covers"),
            F.when(new, state["score"] + 1.0 / (others + 1)).otherwise(state["score"]).alias("score"),
        )

    return F.aggregate(each, start, step, lambda s: F.struct(s["covers"].alias("covers"), s["score"].alias("score")))


def cover_density_rank(hits: DataFrame) -> DataFrame:
    """(request_id, chunk_id, covers, score) from (request_id, chunk_id, place, term, n_terms), a row for each occurrence.

    Chunks that lack a term score 0; repeated rows count once. A group is the occurrences in one chunk."""
    by_term = hits.groupBy("request_id", "chunk_id", "term").agg(F.collect_set("place").alias("places"), F.max("n_terms").alias("n_terms"))
    held = by_term.groupBy("request_id", "chunk_id").agg(F.collect_list("places").alias("places"), F.max("n_terms").alias("n_terms"))
    found = F.when(F.size("places") == F.col("n_terms"), cover_score("places"))
    scored = held.select("request_id", "chunk_id", found.alias("s"))
    return scored.select("request_id", "chunk_id", F.coalesce("s.covers", F.lit(0)).alias("covers"), F.coalesce("s.score", F.lit(0.0)).alias("score"))
