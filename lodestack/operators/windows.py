"""Ordered jobs: first of a group, collisions, evictions, running states."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.functions import fixed
from lodestack.operators.scan import Scan, running, with_totals
from lodestack.shared import written


def dedup_content(files: DataFrame, scope: str = "package", order: str = "ord") -> DataFrame:
    """files (scope, sha256, path, ord) with ``kept``: the path of the first file of the same content in the scope; empty files are their own."""
    empty = ~F.coalesce(F.col("size") > 0, F.lit(False))
    found = with_totals(files.where(~empty), [scope, "sha256"], kept=F.min_by("path", F.struct(order, "path")))
    return found.unionByName(files.where(empty).withColumn("kept", F.col("path")))


#: A path's root and extension; a name that only begins with dots has none.
_ROOT_AND_EXTENSION = r"^((?:.*/)?\.*[^/.][^/]*?)(\.[^./]*)$"


def assign_paths(plan: DataFrame) -> DataFrame:
    """plan (ord, path, ...) with ``local``: in the order of ``ord`` each claimant gets its path or, if that is taken, the first free of stem_1.ext, stem_2.ext, ...

    Names can only meet in a family: paths that differ in trailing _numbers of the stem. A family of one path is numbered by ranges, however many claim
    it; the others are walked in order, and a task keeps the names of one family at a time. Ties of ``ord`` go by path.
    """
    extension = F.regexp_extract("path", _ROOT_AND_EXTENSION, 2)
    root = F.when(extension == "", F.col("path")).otherwise(F.regexp_extract("path", _ROOT_AND_EXTENSION, 1))
    rows = written(plan.withColumns({"__root": root, "__ext": extension}).withColumn("__family", F.concat(F.regexp_replace("__root", r"(_[0-9]+)+$", ""), F.lit("/"), "__ext")))
    mixed = written(rows.groupBy("__family").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").select("__family"))
    single = running(rows.join(mixed, "__family", "left_anti"), F.lit(1), ["ord"], ["path"]).withColumn("__n", F.col("upto") - 1)
    single = single.withColumn("local", F.when(F.col("__n") == 0, F.col("path")).otherwise(F.concat("__root", F.lit("_"), F.col("__n").cast("string"), "__ext")))

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, used, following = None, set(), {}
        for batch in batches:
            out = []
            for own, path, root, ext in zip(*(batch.column(c).to_pylist() for c in ("__family", "path", "__root", "__ext"))):
                if own != family:
                    family, used, following = own, set(), {}
                local, n = path, following.get(path, 1)
                while local in used:
                    local, n = f"{root}_{n}{ext}", n + 1
                following[path] = n
                used.add(local)
                out.append(local)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "local"])

    walked = rows.join(mixed, "__family", "left_semi").repartition("__family").sortWithinPartitions("__family", "ord", "path")
    walked = walked.mapInArrow(named, StructType([*walked.schema.fields, StructField("local", StringType())]))
    return single.select(*plan.columns, "local").unionByName(walked.select(*plan.columns, "local"))


def collisions(assigned: DataFrame) -> DataFrame:
    """The claimants of ``assign_paths``'s result that got another name than their path."""
    return assigned.where("local <> path")


def first_success(attempts: DataFrame, key: str, rank: str, ok: str = "ok") -> DataFrame:
    """Of a key's attempts that went well the first by rank."""
    w = Window.partitionBy(key).orderBy(rank)
    return attempts.where(F.col(ok)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def folded(df: DataFrame, key: str, order: list[str], columns: list[str], first: Callable[[Column], Column], again: Callable[[Column], Column], chunk: int = 4096) -> DataFrame:
    """One row per ``key``: what its rows, in ``order``, fold to. ``first`` makes a summary of an array of rows (structs of ``order`` and ``columns``), ``again`` one
    of an array of summaries. An array has at most ``chunk`` entries, so a hot key is many small rows until few are left."""
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def chunks(rows: DataFrame, by: list[str]) -> DataFrame:
        ranged = written(rows.repartitionByRange(n, key, *by).withColumn("__p", F.spark_partition_id()))
        place = F.row_number().over(Window.partitionBy("__p", key).orderBy(*by))
        return ranged.withColumn("__c", F.floor((place - 1) / chunk))

    rows = chunks(df.select(key, *order, *columns), order)
    level = rows.groupBy(key, "__p", "__c").agg(first(F.sort_array(F.collect_list(F.struct(*order, *columns)))).alias("s"))
    level = written(level.withColumnsRenamed({"__p": "a", "__c": "b"}))
    while (level.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > chunk:
        level = chunks(level, ["a", "b"]).groupBy(key, "__p", "__c").agg(again(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "s"))), lambda x: x["s"])).alias("s"))
        level = written(level.withColumnsRenamed({"__p": "a", "__c": "b"}))
    return level.groupBy(key).agg(again(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "s"))), lambda x: x["s"])).alias("s"))


def evict_lru(files: DataFrame, limit: int) -> DataFrame:
    """The files (path, mtime, size) to evict, oldest first (of one time by path), until the rest is within ``limit`` bytes."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return running(files, F.col("size"), ["mtime", "path"]).where(F.lit(total) - (F.col("upto") - F.col("size")) > limit).drop("upto")


def drop_evicted(index: DataFrame, evicted: DataFrame) -> DataFrame:
    """The index (url, digest) without rows whose file is gone (``evicted``: sha256)."""
    return index.join(evicted.select(F.col("sha256").alias("digest")).distinct(), "digest", "left_anti").select(*index.columns)


def cap_scan(files: DataFrame, group: str, most: int = 3 << 20, each: int = 1 << 20) -> DataFrame:
    """The files of a group that are scanned, in path order: ``take`` bytes of each (at most ``each``) until ``most`` bytes."""
    rows = running(files.withColumn("take", F.least("size", F.lit(each))), F.col("take"), ["path"], [group])
    return rows.withColumn("__before", F.col("upto") - F.col("take")).drop("upto").where(F.col("__before") < most).withColumn("take", F.least("take", F.lit(most) - F.col("__before"))).drop("__before")


def retain_newest(history: DataFrame, k: int = 1000, ts: str = "last_downloaded", key: str = "url") -> DataFrame:
    """The newest row of each key, and of those the ``k`` newest."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    latest = history.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return latest.orderBy(F.desc(ts), key).limit(k)


def cap_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``more``: how many were left out."""
    w = Window.partitionBy(group)
    return df.withColumns({"n": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - k, F.lit(0))}).where(F.col("n") <= k)


def speed_samples(events: DataFrame, key: str = "job", least_gap: float = 0.5) -> DataFrame:
    """events (job, ts, bytes) with ``gap`` seconds since the one before and ``speed`` in bytes a second, null for shorter gaps."""
    rows = Scan(events, ["ts"], [key]).before("__before", F.col("ts")).result()
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("__before").cast("timestamp")) / 1e6
    return rows.withColumn("gap", gap).drop("__before").withColumn("speed", F.when(F.col("gap") >= least_gap, F.col("bytes") / F.col("gap")))


def stage_progress(state: Column, finished: Column, total: Column) -> Column:
    """How far a job in a state is: in the states that load files its share of them in the state's band, else the band's middle, or its end if it has no width."""
    bands = F.create_map(*[x for name, (a, b) in fixed.STAGE_BANDS.items() for x in (F.lit(name), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    band = F.coalesce(F.try_element_at(bands, F.upper(F.coalesce(state, F.lit("IDLE")))), F.struct(F.lit(0.0).alias("a"), F.lit(0.995).alias("b")))
    share = F.when(total > 0, F.least(F.greatest(finished / F.when(total > 0, total), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    loads = F.upper(state).isin("DOWNLOADING", "RETRYING")
    return F.when(loads, band["a"] + (band["b"] - band["a"]) * share).when(band["a"] != band["b"], (band["a"] + band["b"]) / 2).otherwise(band["b"])


def job_progress(events: DataFrame, key: str = "job", value: str | None = None) -> DataFrame:
    """``events`` (job, ts, state, finished, total) with ``shown``, the progress so far: it never goes back. ``value``: a column that has it already."""
    own = F.col(value) if value else stage_progress(F.col("state"), F.coalesce("finished", F.lit(0)), F.coalesce("total", F.lit(0)))
    return Scan(events, ["ts"], [key]).max("shown", own).result().withColumn("shown", F.least("shown", F.lit(1.0)))


def job_latest(events: DataFrame, columns: list[str], key: str = "job") -> DataFrame:
    """``events`` with the last known value of each of ``columns`` so far."""
    rows = Scan(events, ["ts"], [key])
    for c in columns:
        rows.last(f"last_{c}", F.col(c))
    return rows.result()


def rank_scripts(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``rank`` and ``low``, by which scripts are to be read: the application first, libraries last, then by name."""
    low = F.lower(label)
    said = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    return df.withColumns({"rank": F.when(said(fixed.APPLICATION_SCRIPTS), 0).when(said(fixed.LIBRARY_SCRIPTS), 2).otherwise(1), "low": low})


def rank_members(members: DataFrame) -> DataFrame:
    """Archive members that may be the project, with ``rank`` and ``place``, from 1 the likeliest first: by rank, then shortest name, then name; others go."""
    low = F.lower("member")
    project = F.contains(low, F.lit("project"))
    rank = (
        F.when(F.endswith(low, F.lit("project.json")), 0).when(project & F.endswith(low, F.lit(".json")), 1).when(F.endswith(low, F.lit(".json")), 2)
        .when(project & F.endswith(low, F.lit(".txt")), 3).when(F.endswith(low, F.lit(".txt")), 4).when(F.endswith(low, F.lit(".zip")), 5).otherwise(99)
    )
    order = Window.partitionBy("archive").orderBy("rank", F.length("member"), "member")
    return members.where("not is_dir").withColumn("rank", rank).where("rank < 99").withColumn("place", F.row_number().over(order))


def domain_backoff(attempts: DataFrame, base: float = 2.0, most: float = 300.0) -> DataFrame:
    """domain, attempts, backoff, fails after a domain's attempts (domain, ts, ok): a failure starts the backoff at ``base`` or doubles it up to ``most``, a
    success halves it and takes one off the count of fails.

    A run of attempts maps a positive backoff b to min(c, k b), none to z, and a count f to max(m, f + d); runs of bounded length are folded on their own.
    """
    rows = attempts.select(F.lower("domain").alias("domain"), "ts", F.col("ok").cast("boolean").alias("ok"))
    start = F.struct(F.lit(1.0).alias("k"), F.lit(float("inf")).alias("c"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        z = F.when(x["ok"], s["z"] / 2).when(s["z"] > 0, F.least(F.lit(most), s["z"] * 2)).otherwise(base)
        k, c = F.when(x["ok"], s["k"] / 2).otherwise(s["k"] * 2), F.when(x["ok"], s["c"] / 2).otherwise(F.least(F.lit(most), s["c"] * 2))
        move = F.when(x["ok"], -1).otherwise(1)
        m = F.when(x["ok"], F.greatest(s["m"] - 1, F.lit(0))).otherwise(s["m"] + 1)
        return F.struct(k.alias("k"), c.alias("c"), z.alias("z"), (s["d"] + move).alias("d"), m.alias("m"), (s["n"] + 1).alias("n"))

    def join(s: Column, t: Column) -> Column:
        z = F.when(s["z"] > 0, F.least(t["c"], t["k"] * s["z"])).otherwise(t["z"])
        c = F.least(t["c"], F.when(s["c"] == float("inf"), F.lit(float("inf"))).otherwise(t["k"] * s["c"]))
        return F.struct((s["k"] * t["k"]).alias("k"), c.alias("c"), z.alias("z"), (s["d"] + t["d"]).alias("d"), F.greatest(t["m"], s["m"] + t["d"]).alias("m"), (s["n"] + t["n"]).alias("n"))

    out = folded(rows, "domain", ["ts"], ["ok"], lambda xs: F.aggregate(xs, start, step), lambda xs: F.aggregate(xs, start, join))
    return out.select("domain", F.col("s.n").alias("attempts"), F.col("s.z").alias("backoff"), F.col("s.m").alias("fails"))


def ewma_by(samples: DataFrame, key: str, value: str, order: list[str], alpha: float = 0.25) -> DataFrame:
    """key, n, smoothed: the smoothed value after a key's samples. A bad sample counts as 0; a smoothed value that isn't positive starts anew.

    A run of samples maps a positive value v to q v + w, and none to z; runs of bounded length are folded on their own.
    """
    a = min(1.0, max(0.01, alpha))
    start = F.struct(F.lit(1.0).alias("q"), F.lit(0.0).alias("w"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("n"))
    x = F.col(value).cast("double")
    rows = samples.withColumn("__x", F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x))
    step = lambda s, r: F.struct((s["q"] * (1 - a)).alias("q"), (s["w"] * (1 - a) + a * r["__x"]).alias("w"), F.when(s["z"] > 0, s["z"] * (1 - a) + a * r["__x"]).otherwise(r["__x"]).alias("z"), (s["n"] + 1).alias("n"))
    join = lambda s, t: F.struct((s["q"] * t["q"]).alias("q"), (s["w"] * t["q"] + t["w"]).alias("w"), F.when(s["z"] > 0, s["z"] * t["q"] + t["w"]).otherwise(t["z"]).alias("z"), (s["n"] + t["n"]).alias("n"))
    out = folded(rows, key, order, ["__x"], lambda xs: F.aggregate(xs, start, step), lambda xs: F.aggregate(xs, start, join))
    return out.select(key, F.col("s.n").alias("n"), F.col("s.z").alias("smoothed"))


def request_slots(attempts: DataFrame, gap: float = 0.3) -> DataFrame:
    """``attempts`` (domain, ts, backoff seconds) with ``slot`` and ``wait``: the second in which a request may go out, at least ``gap`` after the domain's one
    before and not before its backoff is over. In order n the slot is gap n + the largest of (now + backoff - gap i) up to n: a running maximum."""
    now = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ready = F.col("__now") + F.greatest(F.coalesce("backoff", F.lit(0.0)), F.lit(0.0)) - gap * F.col("__n")
    rows = Scan(attempts.withColumn("__now", now), ["ts"], ["domain"]).sum("__n", F.lit(1)).max("__ready", ready).result()
    rows = rows.withColumn("slot", F.col("__ready") + gap * F.col("__n"))
    return rows.withColumn("wait", F.col("slot") - F.col("__now")).drop("__now", "__n", "__ready")
