"""Streams: records from files, the ledger's daily sums, documents of class calls, and index syncs on arrival."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillet.functions.onto import tron_encode_stream
from quillet.functions.values import PayloadError, loads
from quillet.operators import ledger


def lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines as they arrive: value (blank lines left out), path, bytes with the line end."""
    read = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return read.withColumn("path", F.input_file_name()).filter(F.trim("value") != "").withColumn("bytes", F.octet_length("value") + 1)


def delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """CSV or TSV rows with a header, all texts."""
    return spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", separator).csv(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The ledger's daily sums of a stream of events with a timestamp column `at`; days close `late` after they end."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day")).agg(F.sum("tokens_saved").alias("value"), F.count("*").alias("events"), F.sum(F.col("converted").cast("long")).alias("conversions")).select(F.unix_date(F.col("window.start").cast("date")).cast("long").alias("day"), "value", "events", "conversions")


def running_totals(records: DataFrame, key: str = "path") -> DataFrame:
    """Per stream, after each batch: records and bytes so far, the first record's keys, and whether all records were JSON objects or arrays."""

    def step(k, frames, state: GroupState):
        n, size, keys, valid = state.get if state.exists else (0, 0, None, True)
        for pdf in frames:
            for text in pdf["value"]:
                try:
                    value = loads(text)
                    keys = (",".join(value) if isinstance(value, dict) else "") if keys is None else keys
                except PayloadError:
                    valid = False
                n, size = n + 1, size + len(text.encode()) + 1
        state.update((n, size, keys, valid))
        yield pd.DataFrame({key: [k[0]], "records": [n], "bytes": [size], "keys": [keys], "valid": [valid]})

    return records.groupBy(key).applyInPandasWithState(step, f"{key} string, records long, bytes long, keys string, valid boolean", "n long, size long, keys string, valid boolean", "update", GroupStateTimeout.NoTimeout)


def tron_documents(batch: DataFrame, by: str = "path", order: str = "pos") -> DataFrame:
    """One document of class calls a stream and batch; smaller than its records, or they are kept as they are (converted false). A bad record keeps all of its stream."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(order)["value"].tolist()
        raw = "\n".join(texts) + "\n"
        try:
            out = tron_encode_stream([loads(t) for t in texts])
        except PayloadError:
            out = raw
        smaller = len(out.encode()) < len(raw.encode())
        return pd.DataFrame({by: [pdf[by].iat[0]], "records": [len(texts)], "converted": [smaller], "text": [out if smaller else raw]})

    return batch.groupBy(by).applyInPandas(encode, f"{by} string, records long, converted boolean, text string")


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all there is, batch by batch, and stop."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def record_stream(events: DataFrame, checkpoint: str, *paths: str) -> None:
    """Append a stream of events to one ledger or more."""
    run_to_end(events, lambda batch, _: ledger.record(batch.persist(), *paths), checkpoint)


def watch(spark: SparkSession, root: str, sync: Callable[[], None], checkpoint: str, quiet: str = "2 seconds"):
    """Call sync after each batch of new files; the trigger's interval is the quiet period. Returns the running query."""
    arrivals = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return arrivals.writeStream.trigger(processingTime=quiet).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sync()).start()
