"""Continuous forms of the two incremental behaviours.

The same rules as the batch operators: each product id is processed once, and a
history row is written only when a product's URL changes.  Rows that come late correct
what was written before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery


def first_seen_products(stream: DataFrame) -> DataFrame:
    """Each product id once over the life of the stream (state: the ids seen)."""
    return stream.select("product_id").dropDuplicates(["product_id"])


def register_products(stream: DataFrame, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Append unseen product ids to a Parquet registry until the input is drained.

    A registry that already holds ids from earlier (batch) runs is respected: each
    micro-batch keeps only ids not in it.  Retried batches rewrite their own
    partition and therefore add nothing twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("product_id").distinct()
        try:
            known = spark.read.parquet(registry_path).where(F.col("batch") != batch_id).select("product_id")
        except Exception as e:  # the registry does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(known, "product_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{registry_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


_LOG = "product_id bigint, seq bigint, url string, change int"
_STATE = "settled_url string, settled_seq bigint, seqs array<bigint>, urls array<string>"


def _differs(urls: pd.Series, first: str | None) -> np.ndarray:
    """Which of ``urls`` differ from the one before; before the first comes ``first``."""
    previous = urls.shift(1)
    if len(previous):
        previous.iloc[0] = first
    return (urls != previous).to_numpy()


def _corrections(lateness: int | None):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        settled_url, settled_seq, seqs, urls = state.get if state.exists else (None, None, [], [])
        # Rows that tell nothing go before the batches of a product are put together.
        new = pd.concat([b.loc[b["url"].fillna("") != "", ["seq", "url"]] for b in batches])
        told = pd.DataFrame({"seq": pd.Series(list(seqs), dtype="int64"), "url": pd.Series(list(urls), dtype=object)})
        if settled_seq is not None:
            late = new[new["seq"] <= settled_seq]
            if len(late):
                yield late.assign(product_id=key[0], change=0)[["product_id", "seq", "url", "change"]]
            new = new[new["seq"] > settled_seq]
        # A stable sort after what is known, so that the row of a seq that came first stays.
        rows = pd.concat([told.assign(known=True), new.assign(known=False)]).sort_values("seq", kind="stable").drop_duplicates("seq")
        known = rows["known"].to_numpy(dtype=bool)
        now, was = _differs(rows["url"], settled_url), np.zeros(len(rows), bool)
        was[known] = _differs(rows["url"][known], settled_url)
        change = now.astype("int32") - was.astype("int32")
        if change.any():
            yield rows.assign(product_id=key[0], change=change)[change != 0][["product_id", "seq", "url", "change"]]
        if lateness is not None and len(rows):
            old = rows["seq"] < rows["seq"].iloc[-1] - lateness
            if old.any():
                settled_url, settled_seq = rows["url"][old].iloc[-1], int(rows["seq"][old].iloc[-1])
                rows = rows[~old]
        state.update((settled_url, settled_seq, rows["seq"].tolist(), rows["url"].tolist()))

    return run


def history_log(stream: DataFrame, lateness: int | None = None) -> DataFrame:
    """Log (``product_id, seq, url, change``) of the rows whose URL differs from the product's previous one.

    ``change`` is 1 where such a row enters the history and -1 where a late row shows that an
    entry never was a change; :func:`history_of_log` gives what remains, which is the batch
    history whatever the order in which rows come.  Empty URLs tell nothing, and of several rows with
    one ``seq`` the first to come counts.

    State per product are its rows.  With ``lateness`` these are the rows whose ``seq`` is at most that much
    below the greatest, and the last URL before them: rows that come later still are not lost but logged
    with ``change`` 0, so that a batch run can repair the products that have such rows.
    """
    return (
        stream.select(F.col("product_id").cast("bigint"), F.col("seq").cast("bigint"), "url")
        .groupBy("product_id")
        .applyInPandasWithState(_corrections(lateness), _LOG, _STATE, "append", GroupStateTimeout.NoTimeout)
    )


def history_of_log(log: DataFrame) -> DataFrame:
    """History rows (``product_id, seq, url``) that the log's corrections leave."""
    return (
        log.groupBy("product_id", "seq", "url").agg(F.sum("change").alias("change"))
        .where("change > 0").select("product_id", "seq", "url")
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an append-mode stream to Parquet until the input is drained."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
