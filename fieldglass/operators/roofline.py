"""Roofline classification of operations, layer bottlenecks, vector efficiency.

Nulls and edges: operations of unknown or too short times are left out, those of unknown devices too; unknown byte counts are estimated; a group without operations has null shares; an empty shape list has
no bytes and efficiency 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.guards import ratio
from fieldglass.reftables import DEFAULT_GPU


def device_specs(devices: DataFrame, gpus: DataFrame) -> DataFrame:
    """device, tflops, gbps, architecture: the first table entry whose name is part of the device's name, else defaults."""
    hit = devices.join(F.broadcast(gpus), F.contains(F.col("device"), F.col("gpu")), "left")  # the table has twenty rows
    best = hit.groupBy("device").agg(F.min_by(F.struct("tflops", "gbps", "architecture"), "pos").alias("s"))
    return best.select("device", F.coalesce("s.tflops", F.lit(DEFAULT_GPU[0])).alias("tflops"), F.coalesce("s.gbps", F.lit(DEFAULT_GPU[1])).alias("gbps"), F.col("s.architecture").alias("architecture"))


def op_flops(op: Column, shape: Column, out_features: Column) -> Column:
    """Floating point operations by kind of operation and input shape."""
    n = F.aggregate(shape, F.lit(1.0), lambda acc, x: acc * x)
    return F.when(op == "linear", 2 * n * out_features).when(op.isin("batch_norm", "layer_norm"), 5 * n).when(op == "relu", n).when(op == "gelu", 8 * n).when(op == "silu", 4 * n)


def shape_bytes(shapes: Column) -> Column:
    """Four bytes per element of all shapes whose dimensions are positive."""
    one = lambda s: F.when((F.size(s) > 0) & F.forall(s, lambda d: d > 0), F.aggregate(s, F.lit(4.0), lambda acc, d: acc * d)).otherwise(0.0)
    return F.aggregate(shapes, F.lit(0.0), lambda acc, s: acc + one(s))


def roofline(ops: DataFrame, specs: DataFrame) -> DataFrame:
    """model, op, intensity, achieved, efficiency, bound: operations of at least a microsecond against their device's ridge.

    ``ops``: model, device, op, flops, bytes, time_us. Without a byte count a thousandth of the time stands in.
    """
    known = ops.filter("time_us >= 1").join(specs, "device")
    data = F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(F.col("time_us") * 1e-3)
    achieved = ratio(F.col("flops"), F.col("time_us") * 1e-6)
    ridge = F.col("tflops") * 1e12 / (F.col("gbps") * 1e9)
    out = known.withColumn("intensity", ratio(F.col("flops"), data)).withColumn("achieved", achieved)
    return out.select("model", "op", "intensity", "achieved", ratio(achieved, F.col("tflops") * 1e12).alias("efficiency"), F.when(F.col("intensity") < ridge, "memory").otherwise("compute").alias("bound"))


def bottleneck(classified: DataFrame) -> DataFrame:
    """model, n_memory, n_compute, bottleneck: memory only if more operations are bound by it."""
    out = classified.groupBy("model").agg(F.count_if(F.col("bound") == "memory").alias("n_memory"), F.count_if(F.col("bound") == "compute").alias("n_compute"))
    return out.withColumn("bottleneck", F.when(F.col("n_memory") > F.col("n_compute"), "memory").otherwise("compute"))


def layer_bottlenecks(layers: DataFrame) -> DataFrame:
    """Layers with over 30 % of the operations summed so far (themselves included), in order."""
    so_far = F.sum("flops").over(Window.partitionBy("model").orderBy("pos"))
    return layers.withColumn("share_so_far", ratio(F.col("flops"), so_far)).filter("share_so_far > 0.3")


def layer_rollup(layers: DataFrame) -> DataFrame:
    """model, kind, n, params, size_mb (four bytes a parameter), flops; est_ms at 10 TFLOPS."""
    return layers.groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("params").alias("params"), (F.sum("params") * 4 / 1048576.0).alias("size_mb"), F.sum("flops").alias("flops"), (F.sum("flops") / 1e13 * 1e3).alias("est_ms"))


def inference_time(layers: DataFrame) -> DataFrame:
    """model, cpu_s, gpu_s: all operations of a model at 10 GFLOPS and at 10 TFLOPS; models without any have no row."""
    total = layers.groupBy("model").agg(F.sum("flops").alias("flops")).filter("flops > 0")
    return total.select("model", (F.col("flops") / 1e10).alias("cpu_s"), (F.col("flops") / 1e13).alias("gpu_s"))


def layer_params(layers: DataFrame) -> DataFrame:
    """Adds ``n_params`` of linear and convolution layers: inputs times outputs times kernel, plus a bias per output."""
    kernel = F.aggregate(F.coalesce("kernel", F.array().cast("array<int>")), F.lit(1).cast("long"), lambda acc, k: acc * k)
    return layers.withColumn("n_params", F.col("inputs") * F.col("outputs") * kernel + F.col("outputs"))


def alignment(shapes: Column, op: Column, gpu: Column) -> Column:
    """Expected vector efficiency (0.1 to 1) from how the shapes align."""
    name = F.lower(op)
    last = lambda s: F.element_at(s, -1)
    start = F.when(F.size(shapes) == 0, 0.0).otherwise(0.8)
    coalesced = F.aggregate(shapes, start, lambda acc, s: acc * F.when((F.size(s) > 0) & (last(s) % 8 != 0), 0.7).otherwise(1.0) * F.when(F.exists(s, lambda d: (d % 32 == 0) & (d % 64 != 0)), 0.9).otherwise(1.0))
    dims = F.flatten(F.transform(F.filter(shapes, lambda s: F.size(s) >= 2), lambda s: F.slice(s, -2, 2)))
    fit = lambda d: F.when(d % 64 == 0, 1.0).when(d % 32 == 0, 0.95).when(d % 16 == 0, 0.9).when(d % 8 == 0, 0.85).otherwise(0.7)
    base = F.when(gpu, coalesced).otherwise(start)
    product = base * F.when(name.rlike("matmul|gemm|bmm|addmm"), F.aggregate(dims, F.lit(1.0), lambda acc, d: acc * fit(d))).otherwise(1.0)
    return F.when(F.size(shapes) == 0, 0.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), product)))


def tensor_core(shapes: Column, op: Column, capability: Column) -> Column:
    """Whether an operation can use tensor cores: its kind, and dimensions that are multiples of 8 (of 4 from capability 8)."""
    name = F.lower(op)
    conv = F.flatten(F.transform(F.filter(shapes, lambda s: F.size(s) == 4), lambda s: F.slice(s, 1, 2)))
    rest = F.flatten(F.transform(F.filter(shapes, lambda s: F.size(s) >= 2), lambda s: F.slice(s, -2, 2)))
    dims = F.when(name.contains("conv"), conv).otherwise(rest)
    step = F.when(capability >= 8, 4).otherwise(8)
    return name.rlike("matmul|conv|linear|addmm|bmm|gemm") & (F.size(dims) > 0) & F.forall(dims, lambda d: d % step == 0)
