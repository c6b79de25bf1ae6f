"""Queries over experiment logs, model names and parameter names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.components import checkpoint
from linkloom.operators.ids import parted

#: Fixed value: pattern of model file names.
MODEL_NAME = r"^model([a-zA-Z0-9]+)_hiddensize_(\d+)_drop_(\d+)\.pt$"
#: Stack codes of file names, their layers and whether they have skip connections.
STACKS = (
    ("04", ("sage", "sage", "sage", "sage"), False),
    ("22", ("gat", "gat", "sage", "sage"), False),
    ("1111", ("gat", "sage", "gat", "sage"), False),
    ("1212", ("gat", "sage", "sage", "gat", "sage", "sage"), False),
    ("skip", ("gat", "sage", "sage", "gat", "sage", "sage"), True),
)
#: Fixed value: the code of ``skip`` in commands.
COMMAND_CODES = {"skip": "1212-skip"}
PHASES = (("train", "Training"), ("val", "Validation"), ("test", "Testing"))


def early_stopping(log: DataFrame, patience: int = 5, delta: float = 0.001, run: str = "run") -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch, stopped) of logs (run, epoch, loss).

    An epoch improves if -loss >= best + delta; after ``patience`` epochs in a row without
    improvement the run stops. Rows with a null run or loss are left out; of equal epochs the smaller loss counts first.

    With ``delta`` of 0 or more (less is an error) an epoch that improves has a loss that no earlier one
    undercuts. So rows are dealt by ranges of (run, epoch), a run over as many tasks as it is long; each range knows the
    least loss and the number of rows before it, from one row per range; and only the rows at a running minimum,
    with their places, are folded in order, as a stream. The epoch of the last row that a run takes is looked up by its place.
    """
    if delta < 0:
        raise ValueError("delta is at least 0")
    rows = log.where(F.col("loss").isNotNull() & F.col(run).isNotNull()).select(F.col(run).alias("run"), F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss"))
    rows = parted(rows, ["run", "epoch", "loss"])
    per = rows.groupBy("run", "__part").agg(F.min("loss").alias("__least"), F.count("*").alias("__rows"))
    before = W.partitionBy("run").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("run", "__part", F.min("__least").over(before).alias("__low"), F.sum("__rows").over(before).alias("__seen"))
    carried = per.where("__seen is not null")  # at most one run goes on in each range
    inner = W.partitionBy("__part", "run").orderBy("epoch", "loss")
    rows = rows.join(F.broadcast(carried), ["run", "__part"], "left")
    placed = rows.select(
        "run", "epoch", "loss", (F.row_number().over(inner) + F.coalesce("__seen", F.lit(0))).cast("long").alias("pos"),
        F.least(F.min("loss").over(inner.rowsBetween(W.unboundedPreceding, -1)), "__low").alias("least"),
    )
    placed = checkpoint(placed)
    minima = placed.where("least is null or loss <= least").select("run", "pos", "epoch", "loss")
    folded = _fold_minima(minima, patience, delta)
    size = placed.groupBy("run").agg(F.max("pos").alias("rows"))
    ends = folded.join(size, "run").withColumn("stopped", F.col("best_pos") + patience <= F.col("rows"))
    ends = ends.withColumn("pos", F.when(F.col("stopped"), F.col("best_pos") + patience).otherwise(F.col("rows")))
    out = placed.select("run", "pos", F.col("epoch").alias("stop_epoch")).join(ends, ["run", "pos"])
    return out.select(F.col("run").alias(run), "best_epoch", "best_loss", "stop_epoch", "stopped")


def _fold_minima(minima: DataFrame, patience: int, delta: float) -> DataFrame:
    """(run, best_pos, best_epoch, best_loss) from the running minima (run, pos, epoch, loss) in order; only the state of one run is held."""
    names = ["run", "best_pos", "best_epoch", "best_loss"]
    kind = minima.schema["run"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        stopped = False
        for batch in batches:
            done: list[list] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state or state[0] != row[0]:
                    if state:
                        done.append(state)
                    state, stopped = list(row), False
                elif not stopped:
                    if row[1] > state[1] + patience:
                        stopped = True
                    elif -row[3] >= -state[3] + delta:
                        state = list(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(batch.schema.types)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(state, batch.schema.types, strict=True)], names=names)

    return minima.repartition("run").sortWithinPartitions("run", "pos").mapInArrow(fold, f"run {kind}, best_pos long, best_epoch long, best_loss double")


def best_rows(log: DataFrame, stops: DataFrame, run: str = "run") -> DataFrame:
    """Log rows at the best epoch of their run."""
    best = stops.select(run, F.col("best_epoch").cast(log.schema["epoch"].dataType).alias("epoch"))
    return log.join(best, [run, "epoch"])


def name_parts(name: Column) -> dict[str, Column]:
    """arch, hidden and dropout (tenths) of a model name, and whether the name fits; null if not."""
    fits = name.rlike(MODEL_NAME)

    def part(i: int) -> Column:
        return F.when(fits, F.regexp_extract(name, MODEL_NAME, i))

    return {"arch": part(1), "hidden": part(2).cast("int"), "dropout": part(3).cast("double") / 10, "valid": fits}


def hyper_parameters(names: DataFrame, name: str = "name", ignore: Sequence[str] = ("checkpoint.pt",)) -> DataFrame:
    """Names with their parts; ``valid`` is false for names outside the pattern, ignored names left out."""
    return names.where(~F.col(name).isin(*ignore)).withColumns(name_parts(F.col(name)))


def model_name(arch: Column, hidden: Column, tenths: Column) -> Column:
    return F.format_string("model%s_hiddensize_%d_drop_%02d.pt", arch, hidden, tenths)


def checkpoint_index(names: DataFrame) -> DataFrame:
    """(arch, settings): the sorted set of (hidden, dropout) of every stack."""
    good = hyper_parameters(names).where("valid")
    return good.groupBy("arch").agg(F.array_sort(F.collect_set(F.struct("hidden", "dropout"))).alias("settings"))


def layer_stacks(keys: DataFrame) -> DataFrame:
    """(model, layers, skip) from parameter names (model, key).

    A layer is ``gat`` if one of its keys holds ``.att_src``, else ``sage``; ``skip`` if any key starts
    with ``gnn.lin1.``.
    """
    k = keys.withColumn("layer", F.regexp_extract("key", r"^gnn\.conv(\d+)\.", 1))
    skip = k.groupBy("model").agg(F.bool_or(F.col("key").startswith("gnn.lin1.")).alias("skip"))
    kinds = k.where("layer <> ''").groupBy("model", F.col("layer").cast("int").alias("layer")).agg(F.bool_or(F.col("key").contains(".att_src")).alias("gat"))
    kinds = kinds.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("layer", "gat"))).alias("l"))
    return skip.join(kinds, "model", "left").select(
        "model", F.transform(F.coalesce("l", F.array().cast("array<struct<layer:int,gat:boolean>>")), lambda s: F.when(s["gat"], "gat").otherwise("sage")).alias("layers"), "skip"
    )


def stack_table(spark: SparkSession) -> DataFrame:
    """(arch, command, layers, skip): the code in file names, the one in commands, and the stack."""
    rows = [(c, COMMAND_CODES.get(c, c), list(layers), skip) for c, layers, skip in STACKS]
    return spark.createDataFrame(rows, "arch string, command string, layers array<string>, skip boolean")


def phase_of(split: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, p in PHASES:
        out = F.when(split == s, p).otherwise(out)
    return out


def parameter_grid(sizes: DataFrame, dropouts: DataFrame) -> DataFrame:
    """Every pair of a size and a dropout (short parameter lists)."""
    return sizes.crossJoin(dropouts)


def expected_metrics(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """The first log row of each wanted (size, dropout, phase): equal size, dropout within 1e-12, phase in any case.

    ``log`` needs a column ``row_no``.
    """
    w, m = wanted.alias("w"), log.alias("m")
    near = (F.col("w.size") == F.col("m.size")) & (F.lower("w.phase") == F.lower("m.phase")) & (F.abs(F.col("w.dropout") - F.col("m.dropout")) < 1e-12)
    hit = w.join(m, near).groupBy("w.size", "w.dropout", "w.phase").agg(F.min_by(F.struct("m.*"), "m.row_no").alias("r"))
    return hit.select("size", "dropout", "phase", *(F.col(f"r.{c}").alias(c) for c in log.columns if c not in ("size", "dropout", "phase")))


def not_covered(log: DataFrame, names: DataFrame) -> DataFrame:
    """Settings (size, dropout) of the log for which no model exists, of any stack."""
    have = hyper_parameters(names).where("valid").select(F.col("hidden").alias("size"), "dropout").distinct()
    return log.select("size", "dropout").distinct().join(have, ["size", "dropout"], "left_anti")


def heat_map(log: DataFrame, dropouts: Sequence[float], value: str = "auc") -> DataFrame:
    """Size x dropout table of 100 x value (the first in order of value where several)."""
    out = log.groupBy("size").pivot("dropout", list(dropouts)).agg(F.min(F.col(value) * 100))
    return out.select("size", *(F.col(f"`{d}`").alias(f"d{int(round(d * 10)):02d}") for d in dropouts))
