"""Claims from normalised intelligence (ENR-03 to ENR-08, ENR-10, ENR-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_unit_price
from ..scratch import table
from .merges import upsert_entities


def tag_attributions(tags: DataFrame) -> DataFrame:
    """ENR-03: attributions of tags that are ok, each content once."""
    return tags.filter("outcome = 'ok'").select("chain", "address", "label", "category", "confidence", "note").distinct()


def tag_risks(tags: DataFrame) -> DataFrame:
    """ENR-04: a categorical risk (no score) for each tag with an abuse type; its rationale is the label and, if there is one, the backlink."""
    why = F.concat_ws(" — ", "label", "backlink")
    return tags.filter("outcome = 'ok' and abuse is not null").select("chain", "address", F.col("abuse").alias("category"), why.alias("rationale")).distinct()


def actor_entities(actors: DataFrame, tags: DataFrame) -> DataFrame:
    """ENR-05: one entity per actor id, whichever came first: an actor's name replaces the stub of a tag, a type only fills."""
    named = actors.select("external_id", "name", "kind", F.lit(0).alias("seq"))
    stubs = tags.filter("outcome = 'ok' and actor is not null").select(F.col("actor").alias("external_id"), F.col("actor").alias("name"), F.col("category").alias("kind"), F.lit(1).alias("seq"))
    return upsert_entities(named.unionByName(stubs.distinct()))


def actor_memberships(tags: DataFrame) -> DataFrame:
    """ENR-05: memberships of tagged addresses in their actors' entities, each once, with the flag of cluster definers."""
    rows = tags.filter("outcome = 'ok' and actor is not null")
    return rows.groupBy(F.col("actor").alias("external_id"), "chain", "address").agg(F.max("confidence").alias("confidence"), F.when(F.max("cluster_definer"), "cluster-definer").alias("flags"))


def vendor_memberships(entities: DataFrame) -> DataFrame:
    """ENR-06: memberships by (entity, address, method): confirmed and predicted ones stay apart, each with its confidence."""
    return entities.groupBy("external_id", "address", "method").agg(F.max("confidence").alias("confidence"))


def risk_rows(headline: DataFrame, signals: DataFrame) -> DataFrame:
    """ENR-07: the headline and its sub-signals as rows (address, level, category, score); without a score there is no headline and no signal."""
    scored = headline.filter("score is not null")
    top = scored.select("address", F.lit("headline").alias("level"), "category", "score").distinct()
    return top.unionByName(signals.join(scored.select("address").distinct(), "address", "left_semi").select("address", F.lit("signal").alias("level"), F.col("signal").alias("category"), "score").distinct())


def reported_valuations(transfers: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """ENR-08: the source's own total as a further valuation (id, value verbatim, unit_price derived exactly, source) of movements it has not valued yet.

    No row without a time or for an amount of zero.
    """
    price = exact_unit_price("historical_usd", "amount", "decimals")
    new = transfers.filter("historical_usd is not null and block_ts <> ''").join(known.filter(F.col("source") == source).select("id"), "id", "left_anti")
    return new.select("id", F.col("historical_usd").alias("value"), price.alias("unit_price"), F.lit(source).alias("source")).filter("unit_price is not null")


def register_approvals(approvals: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ENR-10: addresses that approvals name (owners, spenders, tokens), and the approvals that are not there yet, each once by (owner, spender, token, tx_hash)."""
    keys = ["owner", "spender", "token", "tx_hash"]
    named = approvals.select(F.explode(F.array(*(F.struct(F.col(c).alias("address"), F.lit(c).alias("role")) for c in ("owner", "spender", "token")))).alias("a")).select("a.*").distinct()
    new = approvals.groupBy(*keys).agg(F.min_by("amount", "block_height").alias("amount"), F.min("block_height").alias("block_height"))
    same = [new[k].eqNullSafe(existing[k]) for k in keys]
    return named, new.join(existing, same, "left_anti")


def evidence(rosters: dict[str, DataFrame], folder: str) -> DataFrame:
    """ENR-13: every roster of a case written as a Parquet folder of its own; returns roster, rows. Rendering is left to others."""
    counts = []
    for name, rows in rosters.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = rows.sparkSession
        counts.append(spark.read.schema(rows.schema).parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("roster"), "rows"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return table(out, "evidence")
