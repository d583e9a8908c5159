"""Cloud cost: instance choice, forecasts, serverless estimates, parallelism advice.

Nulls and edges: unknown utilizations count as one half, unknown GPUs as one, unknown memory as none; a provider whose costs are all 0 or null has null scores; results without throughput
or memory are not ranked; ties go to the first name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.guards import ratio


def provisioning(gpu_util: Column, memory_util: Column) -> Column:
    """over, under or right; missing utilization counts as one half."""
    g, m = F.coalesce(gpu_util, F.lit(0.5)), F.coalesce(memory_util, F.lit(0.5))
    return F.when((g < 0.7) & (m < 0.7), "over").when((g > 0.9) | (m > 0.9), "under").otherwise("right")


def instance_scores(prices: DataFrame, cost: float = 1.0, performance: float = 0.0, memory: float = 0.0) -> DataFrame:
    """Adds cost_score, performance_score, memory_score and their weighted sum ``score`` within each provider; weights are brought to sum 1."""
    total = (cost + performance + memory) or 1.0
    # one row a provider
    most = prices.groupBy(F.col("provider").alias("of_")).agg(F.max("cost").alias("most_cost_"), F.max("ram").alias("most_ram_"))
    prices = prices.join(most, F.col("provider").eqNullSafe(F.col("of_"))).drop("of_")
    kind = F.coalesce("gpu_type", F.lit(""))
    rank = F.when(kind.contains("A100"), 1.0).when(kind.contains("V100"), 0.8).when(kind.contains("A10G"), 0.7).when(kind.contains("T4"), 0.5).otherwise(0.0)
    scored = prices.withColumns({
        "cost_score": 1 - ratio(F.col("cost"), F.col("most_cost_")),
        "performance_score": rank * F.least(F.coalesce("gpus", F.lit(1)) / 8, F.lit(1.0)),
        "memory_score": ratio(F.coalesce("ram", F.lit(0)), F.col("most_ram_")),
    }).drop("most_cost_", "most_ram_")
    return scored.withColumn("score", (F.col("cost_score") * cost + F.col("performance_score") * performance + F.col("memory_score") * memory) / total)


def recommend(prices: DataFrame, fleet: DataFrame, model_size_gb: float | None = None, **weights: float) -> DataFrame:
    """name, provisioning, current, current_cost, instance, cost, change_percent, score, rank: for each over- or under-provisioned machine of
    ``fleet`` (name, provider, instance, gpu_util, memory_util) the cheaper or dearer instances by falling score. An unknown instance is an error."""
    scored = instance_scores(prices, **weights)
    listed = prices.select(F.col("provider").alias("kp"), F.col("instance").alias("k"), F.col("cost").alias("current_cost"))
    known = fleet.join(listed, (F.col("provider") == F.col("kp")) & (F.col("instance") == F.col("k")), "left")
    own = known.withColumn("current_cost", F.coalesce("current_cost", F.raise_error(F.concat(F.lit("unknown instance: "), "instance")).cast("double")))
    own = own.select("name", F.col("provider").alias("p"), F.col("instance").alias("current"), "current_cost", provisioning(F.col("gpu_util"), F.col("memory_util")).alias("provisioning"))
    fits = scored if model_size_gb is None else scored.filter(F.coalesce("ram", F.lit(0)) >= model_size_gb)
    wanted = ((F.col("provisioning") == "over") & (F.col("cost") < F.col("current_cost"))) | ((F.col("provisioning") == "under") & (F.col("cost") > F.col("current_cost")))
    options = own.join(fits, (F.col("p") == F.col("provider")) & (F.col("instance") != F.col("current"))).filter(wanted)
    best = Window.partitionBy("name").orderBy(F.desc(F.round("score", 12)), "instance")
    return options.withColumn("rank", F.row_number().over(best)).select("name", "provisioning", "current", "current_cost", "instance", "cost", (ratio(F.col("cost") - F.col("current_cost"), F.col("current_cost")) * 100).alias("change_percent"), "score", "rank")


def pricing_advice(fleet_costs: DataFrame) -> DataFrame:
    """name, model, savings_per_hour: what interruptible (70 %) and reserved (40 %) pricing would save (first provider only)."""
    offers = F.array(F.struct(F.lit("spot").alias("model"), F.lit(0.7).alias("share")), F.struct(F.lit("reserved_1yr").alias("model"), F.lit(0.4).alias("share")))
    return fleet_costs.filter("provider = 'aws'").select("name", "cost", F.inline(offers)).select("name", "model", (F.col("cost") * F.col("share")).alias("savings_per_hour"))


def forecast(prices: DataFrame, hours_per_day: float, days_per_month: int = 30) -> DataFrame:
    """provider, instance, hours, monthly and annual cost on demand and reserved for one and three years."""
    hours = float(hours_per_day * days_per_month)
    month = F.col("cost") * hours
    return prices.select("provider", "instance", F.lit(hours).alias("hours"), month.alias("monthly"), (month * 0.6).alias("monthly_1yr"), (month * 0.4).alias("monthly_3yr"), (month * 12).alias("annual"), (month * 0.6 * 12).alias("annual_1yr"), (month * 0.4 * 12).alias("annual_3yr"))


def serverless(loads: DataFrame) -> DataFrame:
    """name, provider, monthly_cost, rank, pct_above_best from latency_s, peak_bytes and requests, with floors of 1 ms and 128 MB."""
    s = F.greatest(F.lit(0.001), F.coalesce("latency_s", F.lit(0.001)))
    gb = F.greatest(F.lit(0.128), F.greatest(F.lit(134217728.0), F.coalesce(F.col("peak_bytes").cast("double"), F.lit(0.0))) / 1073741824)
    n = F.col("requests").cast("double")
    offers = F.array(
        F.struct(F.lit("aws").alias("provider"), (n * gb * s * 0.0000166667).alias("monthly_cost")),
        F.struct(F.lit("gcp").alias("provider"), (0.40 * n / 1e6 + 0.00001 * s * n + 0.0000025 * gb * s * n).alias("monthly_cost")),
        F.struct(F.lit("azure").alias("provider"), (0.20 * n / 1e6 + 0.000016 * gb * s * n).alias("monthly_cost")),
    )
    w = Window.partitionBy("name")
    long = loads.select("name", F.inline(offers))
    best = F.greatest(F.lit(0.0001), F.min("monthly_cost").over(w))
    return long.withColumn("rank", F.row_number().over(w.orderBy("monthly_cost", "provider"))).withColumn("pct_above_best", (F.col("monthly_cost") / best - 1) * 100)


def parallelism(models: DataFrame) -> DataFrame:
    """Adds ``strategy`` by the number of parameters."""
    p = F.col("parameters")
    return models.withColumn("strategy", F.when(p < 1e9, "data parallel").when(p < 1e10, "sharded data parallel").otherwise("data, model and pipeline parallel"))


def applicable_strategies(models: DataFrame) -> DataFrame:
    """model, strategy: what the size against one device's memory makes worth trying (0.3 and 0.7 of it are the borders)."""
    share = ratio(F.col("size_gb"), F.col("device_gb"))
    options = F.array(F.lit("data parallel"), F.when(share > 0.3, "sharded data parallel"), F.when(share > 0.7, "pipeline parallel"))
    return models.select("model", F.explode(F.array_compact(options)).alias("strategy"))


def rank_strategies(results: DataFrame) -> DataFrame:
    """strategy, throughput, memory_gb, throughput_rank, memory_rank; results without a positive throughput are left out."""
    ok = results.filter("throughput > 0 and memory_gb is not null")
    return ok.withColumn("throughput_rank", F.rank().over(Window.orderBy(F.desc("throughput")))).withColumn("memory_rank", F.rank().over(Window.orderBy("memory_gb")))


def best_ratio(results: DataFrame) -> DataFrame:
    """provider, instance with the highest throughput per cost."""
    r = ratio(F.col("throughput"), F.col("cost"))
    return results.agg(F.max_by(F.struct("provider", "instance", r.alias("throughput_per_cost")), F.struct(r, "instance")).alias("x")).select("x.*")


def loader_advice(sweep: DataFrame) -> DataFrame:
    """loader, kind, value: best batch size (first of the highest throughput), fewest workers within 5 % of the best, and what follows from them.

    ``sweep``: loader, framework, dimension (batch_size or workers), setting, throughput.
    """
    top = sweep.join(sweep.groupBy("loader", "dimension").agg(F.max("throughput").alias("most")), ["loader", "dimension"])
    batch = top.filter("dimension = 'batch_size' and throughput = most").groupBy("loader", "framework").agg(F.min("setting").alias("value")).select("loader", F.lit("batch_size").alias("kind"), "value")
    few = top.filter("dimension = 'workers' and throughput >= 0.95 * most").groupBy("loader", "framework").agg(F.min("setting").alias("value"))
    workers = few.filter("value > 0").select("loader", F.lit("num_workers").alias("kind"), "value")
    pin = few.filter("framework = 'pytorch' and value > 0").select("loader", F.lit("pin_memory").alias("kind"), F.lit(1).alias("value"))
    prefetch = sweep.filter("framework = 'tensorflow'").select("loader").distinct().select("loader", F.lit("prefetch").alias("kind"), F.lit(1).alias("value"))
    return batch.unionByName(workers).unionByName(pin).unionByName(prefetch)


def hardware_advice(hardware: DataFrame) -> DataFrame:
    """host, workers, precision, batch_size from cores, memory and device: workers leave one core; half precision from capability 7; batch is the largest power of two that fits."""
    spare = F.greatest(F.lit(1), F.least(F.col("cores") - 1, F.lit(16)))
    fit = F.floor(F.try_divide(F.col("device_gb") * 0.8 * 1024, F.col("sample_mb")))
    return hardware.select("host", spare.alias("workers"), F.when(F.col("device_gb").isNull(), "fp32").when(F.col("capability") >= 8, "bf16").when(F.col("capability") >= 7, "fp16").otherwise("fp32").alias("precision"), F.when(fit >= 1, F.pow(F.lit(2.0), F.floor(F.log2(fit.cast("double"))))).otherwise(1.0).cast("long").alias("batch_size"))


def top_alternatives(recommended: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` best alternatives of each machine: a top list of :func:`recommend`."""
    return recommended.filter(F.col("rank") <= most)


def comparison(recommended: DataFrame, prices: DataFrame, most: int = 5) -> DataFrame:
    """name, place, instance, cost, gpus, memory: each machine's own instance (place 0) and its best alternatives, as a chart shows them; machines without an alternative have no row."""
    top = top_alternatives(recommended, most)
    own = top.select("name", F.lit(0).alias("place"), F.col("current").alias("instance")).distinct()
    rows = own.unionByName(top.select("name", F.col("rank").alias("place"), "instance"))
    facts = prices.select(F.col("instance").alias("of"), "cost", F.coalesce("gpus", F.lit(0)).alias("gpus"), F.coalesce("ram", F.lit(0)).alias("memory"))
    return rows.join(facts, F.col("instance") == F.col("of")).select("name", "place", "instance", "cost", "gpus", "memory")


def cost_breakdown(recommended: DataFrame) -> DataFrame:
    """name, current, recommended, savings (0 if the recommendation is dearer) per hour."""
    best = recommended.filter("rank = 1")
    return best.select("name", F.col("current_cost").alias("current"), F.col("cost").alias("recommended"), F.greatest(F.lit(0.0), F.col("current_cost") - F.col("cost")).alias("savings"))


def validated_results(results: DataFrame) -> DataFrame:
    """strategy, status: ``missing`` values, ``invalid`` throughput (not positive), else ``ok``."""
    return results.select("strategy", F.when(F.col("throughput").isNull() | F.col("memory_gb").isNull(), "missing").when(F.col("throughput") <= 0, "invalid").otherwise("ok").alias("status"))
