"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a budget of tokens. A source whose documents are all taken ``budget div tokens`` times (complete epochs) has a
rest, which is filled without replacement: each document draws the exponential key ``-ln(u) / weight``, with u from the MD5 of
seed and doc_id, and the documents with the smallest keys whose running total of tokens stays within the rest are taken once more.

Weights are those of the ledger of quality rules (``ledger.weight``): an eighth for every rule of the current policy that a document fails.
Tokens are the ledger's words. So mixing needs a ledger and no texts; one is made where none is given.

Defined results: a null text or one without tokens has no tokens and costs nothing, so it is taken whenever the order reaches it;
a document with more tokens than are left is passed over, with all after it; a null source is a source of its own; rows without doc_id share one draw; ties are ordered by doc_id and tokens, and rows equal in
all of these may be taken in any order; an empty table gives none; a very long text is counted whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import ledger
from graphloom.llm.common import running_total
from graphloom.session import stored

def entries_of(docs: DataFrame) -> DataFrame:
    """The ledger that ``mix`` takes, stored."""
    return ledger.record(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), ("source",))


def mix(entries: DataFrame, shares: dict[str, float] | None = None, total: int | None = None, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, n_tokens, running_tokens, copies)`` of each document that is taken.

    shares: each source's part of the total, by default the same for all; sources not named get none. total: tokens in all, by
    default as many as the documents have. entries: a ledger with ``source``, as ``entries_of`` makes it.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = stored(entries.select("doc_id", "source", F.col("n_words").alias("n_tokens"), (-F.log(u) / ledger.weight()).alias("_key")))
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("_tokens"))
    if shares is None:
        spread = sums.agg(F.count("*").alias("_n"), F.sum("_tokens").alias("_all"))
        budget = F.floor((F.lit(total) if total is not None else F.col("_all")) / F.col("_n"))
    else:
        spread = sums.agg(F.sum("_tokens").alias("_all"))
        part = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in shares.items()], F.lit(0.0))
        budget = F.floor((F.lit(total) if total is not None else F.col("_all")) * part)
    budgets = sums.crossJoin(spread).select(F.col("source").alias("_source"), F.when(F.col("_tokens") > 0, F.floor(budget / F.col("_tokens"))).otherwise(0).alias("_epochs"), F.when(F.col("_tokens") > 0, budget % F.col("_tokens")).otherwise(0).alias("_rest"))
    ordered = running_total(rows, ["source"], ["_key", "doc_id", "n_tokens"], "n_tokens", "running_tokens")
    taken = ordered.join(budgets, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("_epochs") + F.when((F.col("running_tokens") <= F.col("_rest")) & (F.col("_rest") > 0), 1).otherwise(0)
    return taken.select("doc_id", "source", "n_tokens", "running_tokens", copies.cast("long").alias("copies")).where("copies > 0")


ORACLE = f"""
WITH e AS ({ledger.WITH_SOURCE}),
k AS (SELECT doc_id, source, n_words AS n_tokens, -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / (1.0 / (1::BIGINT << (3 * bit_count(failures & {ledger.mask(ledger.CURRENT)})))::DOUBLE) AS key FROM e),
s AS (SELECT source, sum(n_tokens) AS tokens FROM k GROUP BY source),
b AS (SELECT source, tokens, (SELECT sum(tokens) // count(*) FROM s) AS budget FROM s),
r AS (SELECT k.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running FROM k)
SELECT r.doc_id, r.source, n_tokens::BIGINT AS n_tokens, running::BIGINT AS running_tokens,
  (budget // tokens + CASE WHEN budget % tokens > 0 AND running <= budget % tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r JOIN b USING (source) WHERE budget // tokens + CASE WHEN budget % tokens > 0 AND running <= budget % tokens THEN 1 ELSE 0 END > 0
"""
