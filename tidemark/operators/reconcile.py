"""What the kernel said of an end, what was sampled before it, and what was seen to start, made one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.endings import describe, level, status_text
from ..functions.numbers import micros, percent_text
from ..functions.text import human_bytes, human_duration
from ..sources.shared import cut
from .lineage import TOLERANCE


def nearest(left: DataFrame, right: DataFrame, on=("host", "pid"), time: str = "start", tolerance: float = TOLERANCE, keep=(), prefix: str = "near_") -> DataFrame:
    """``left`` with the columns ``keep`` of the row of ``right`` with the same keys whose time is nearest, within the tolerance.

    Time is cut into pieces as long as the tolerance: a row of the right is in its own piece, one of the left asks in three, so the join is by equality.
    Of equally near rows the earlier counts, then the smaller values. Each left row stays once.
    """
    on = list(on)
    # written before it is read twice: numbers made anew by each reader differ where rows come out of an exchange in another order
    tagged = cut(left.withColumn("_row", F.monotonically_increasing_id()))
    piece = lambda t: F.floor(F.col(t) / tolerance)
    asked = tagged.withColumn("_piece", F.explode(F.array(*[piece(time) + d for d in (-1, 0, 1)])))
    told = right.select(*on, piece(time).alias("_piece"), F.col(time).alias("_time"), F.struct(*keep).alias("_kept"))
    close = asked.join(told, [*on, "_piece"]).where(F.abs(F.col(time) - F.col("_time")) <= tolerance)
    best = close.groupBy("_row").agg(F.min_by(F.struct("_time", "_kept"), F.struct(F.abs(F.col(time) - F.col("_time")), "_time", "_kept")).alias("_best"))
    out = tagged.join(best, "_row", "left")
    return out.select(*left.columns, F.col("_best._time").alias(f"{prefix}{time}"), *[F.col(f"_best._kept.{c}").alias(f"{prefix}{c}") for c in keep])


#: Kinds of evidence of a process, from what has known it longest to what knows it least: a sweep, a sweep whose process is gone without a word, its exec, its end, and what is there now.
EVIDENCE = ("sample", "unexplained", "exec", "ending", "live")


def known_parents(children: DataFrame, evidence: DataFrame, keep=("pgid",), tolerance: float = TOLERANCE, kinds=EVIDENCE) -> DataFrame:
    """``children`` (host, ppid, start, ...) with parent_kind, parent_start and parent_<keep>: their parents by the best kind of evidence.

    Of evidence (host, pid, start, kind, ...) the first of ``kinds`` counts that there is for the parent's pid, and of that kind the greatest start that is no later than the child's, give or take the tolerance:
    what took the number later is no parent. One union and one window by (host, pid), which holds the last of each kind; no pairs are made.
    """
    told = evidence.where(F.col("kind").isin(*kinds)).select("host", F.col("pid").alias("_pid"), F.col("start").alias("_t"), F.lit(0).alias("_ask"), F.struct(F.col("kind").alias("kind"), F.col("start").alias("start"), *keep).alias("_known"))
    asked = children.withColumns({"_pid": F.col("ppid"), "_t": F.col("start") + tolerance, "_ask": F.lit(1)})
    w = Window.partitionBy("host", "_pid").orderBy("_t", "_ask", "_known").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("_known")["kind"] == k, F.col("_known")), True).over(w) for k in kinds]
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("_best", F.coalesce(*last))
    return both.where("_ask = 1").select(*children.columns, F.col("_best.kind").alias("parent_kind"), F.col("_best.start").alias("parent_start"), *[F.col(f"_best.{c}").alias(f"parent_{c}") for c in keep])


def described(exits: DataFrame, sampled: DataFrame, execs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``exits`` (host, pid, start, comm, ppid, forked) with cmdline, unit and described_by: what each had been running.

    First the sample of the process, then its exec; if it only forked and has its parent's name, what the parent was: the last sample of the parent that began no later than the child, or else its exec, if that process
    began when the child did, give or take the tolerance; else nothing but the sample's or exec's unit.
    """
    keep = ("cmdline", "unit")
    a = nearest(exits, sampled, tolerance=tolerance, keep=keep, prefix="s_")
    b = nearest(a, execs, tolerance=tolerance, keep=keep, prefix="e_")

    def parents(children: DataFrame, rows: DataFrame, name: str, band: bool) -> DataFrame:
        """By (host, ppid, comm), so one of another name in between hides none."""
        told = rows.select("host", F.col("pid").alias("ppid"), "comm", F.col("start").alias("_t"), F.lit(0).alias("_ask"), F.struct("start", "cmdline", "unit").alias("_p"))
        asked = children.withColumns({"_t": F.col("start") + tolerance, "_ask": F.lit(1)})
        w = Window.partitionBy("host", "ppid", "comm").orderBy("_t", "_ask", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = asked.unionByName(told, allowMissingColumns=True).withColumn("_last", F.last("_p", True).over(w)).where("_ask = 1")
        near = F.col("_last.start") >= F.col("start") - tolerance if band else F.lit(True)
        return found.select(*children.columns, F.when(F.col("forked") & near, F.col("_last")).alias(name))

    c = parents(parents(b, sampled, "_sampled", False), execs, "_called", True)
    text = lambda x: F.nullif(x, F.lit(""))
    parent = F.coalesce(text(F.col("_sampled.cmdline")), text(F.col("_called.cmdline")))
    said = F.coalesce(text(F.col("s_cmdline")), text(F.col("e_cmdline")), parent)
    by = F.when(text(F.col("s_cmdline")).isNotNull(), "sample").when(text(F.col("e_cmdline")).isNotNull(), "exec").when(parent.isNotNull(), "parent")
    return c.select(*exits.columns, said.alias("cmdline"), F.coalesce("s_unit", "e_unit", "_sampled.unit", "_called.unit").alias("unit"), by.alias("described_by"))


def vanished(sampled: DataFrame, exits: DataFrame, sweeps: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Sampled processes (host, pid, start, last_seen) that were gone for two sweeps without word of their end; noticed is the second of these.

    ``sweeps`` (host, ts). One sweep is waited, for an exit that is heard of late.
    """
    heard = nearest(sampled, exits, tolerance=tolerance, keep=("pid",), prefix="x_").where("x_start is null").drop("x_start", "x_pid")
    later = sweeps.withColumn("_next", F.lead("ts", 2).over(Window.partitionBy("host").orderBy("ts"))).select("host", F.col("ts").alias("last_seen"), F.col("_next").alias("noticed"))
    return heard.join(later, ["host", "last_seen"]).where("noticed is not null")


def exit_records(processes: DataFrame) -> DataFrame:
    """Merged processes, beside what was sampled of them (sampled_user_seconds, sampled_system_seconds, sampled_rss_bytes, sampled_read_bytes, sampled_write_bytes), as accounting records.

    Of each figure the greater counts: the kernel did not see threads that ended before it was listened to, the sampler not what was used after its last sweep.
    """
    more = lambda a, b: F.greatest(F.col(a), F.col(b)) if b in processes.columns else F.col(a)
    p = processes.withColumns({"_user": F.col("user_us") / 1e6, "_system": F.col("system_us") / 1e6, "_rss": F.col("peak_rss_kb") * 1024})
    p = p.withColumns({"_user": more("_user", "sampled_user_seconds"), "_system": more("_system", "sampled_system_seconds"), "_rss": more("_rss", "sampled_rss_bytes"), "_read": more("read_bytes", "sampled_read_bytes"), "_write": more("write_bytes", "sampled_write_bytes")})
    cpu = F.col("_user") + F.col("_system")
    status = status_text("exit_status")
    message = F.concat(F.col("comm"), F.lit("["), F.col("tgid").cast("string"), F.lit("] "), describe("exit_status", "flag"), F.lit(" after "), human_duration("elapsed_seconds"), F.lit(", cpu "), human_duration(cpu), F.lit(", peak rss "), human_bytes("_rss"))
    return p.select(
        (F.col("end_epoch") * 1e6).cast("bigint").alias("ts_us"), level(status).alias("level"), message.alias("message"), F.lit("exit").alias("kind"), F.lit("taskstats").alias("source"), F.col("comm").alias("service"), status.alias("status"), "host", F.col("tgid").alias("pid"), "ppid", "uid", "gid", "nice",
        micros("start_epoch").alias("started"), micros("elapsed_seconds").alias("elapsed_seconds"), micros(cpu).alias("cpu_seconds"), percent_text(cpu, "elapsed_seconds").alias("cpu_pct"), "threads", F.col("_rss").alias("peak_rss_bytes"), F.col("_read").alias("io_read_bytes"), F.col("_write").alias("io_write_bytes"), F.when(F.col("forked"), True).alias("forked"),
    )


def vanished_records(gone: DataFrame) -> DataFrame:
    """Records of processes that vanished: floors, of the last sweep that saw them."""
    elapsed = F.greatest(F.col("last_seen") - F.col("start"), F.lit(0.0))
    message = F.concat(F.col("comm"), F.lit("["), F.col("pid").cast("string"), F.lit("] gone after at least "), human_duration(elapsed), F.lit(", cpu at least "), human_duration("cpu_seconds"), F.lit(", peak rss "), human_bytes("peak_rss_bytes"))
    return gone.select((F.col("noticed") * 1e6).cast("bigint").alias("ts_us"), F.lit("info").alias("level"), message.alias("message"), F.lit("exit").alias("kind"), F.lit("sampled").alias("source"), F.col("comm").alias("service"), F.lit("unknown").alias("status"), "host", "pid", micros("start").alias("started"), micros("last_seen").alias("last_seen"), micros(elapsed).alias("elapsed_seconds"), micros("cpu_seconds").alias("cpu_seconds"), percent_text("cpu_seconds", elapsed).alias("cpu_pct"), "peak_rss_bytes")


def residual_cpu(exits: DataFrame, sampled_seconds: str = "sampled_seconds") -> DataFrame:
    """What a process used between its last sample and its end; not under 0."""
    return exits.withColumn("residual_seconds", F.greatest(F.col("cpu_seconds") - F.coalesce(sampled_seconds, F.lit(0.0)), F.lit(0.0)))


def started_as(notes: DataFrame) -> DataFrame:
    """(host, pid, start, at, cmdline) execs -> cmdline (the last) and started_as (the first that is no launcher's, if it differs)."""
    from ..functions.text import is_launcher

    seen = notes.groupBy("host", "pid", "start").agg(F.max_by("cmdline", "at").alias("cmdline"), F.min_by("cmdline", F.when(~is_launcher("cmdline"), F.col("at"))).alias("_first"))
    return seen.select("host", "pid", "start", "cmdline", F.when(F.col("_first") != F.col("cmdline"), F.col("_first")).alias("started_as"))


def spans_of(records: DataFrame, identities: DataFrame) -> DataFrame:
    """A span for each record, with its process's identity (host, pid, start_us as both have them)."""
    from ..functions.endings import span_ending, span_status

    joined = records.join(identities, ["host", "pid", "start_us"])
    return joined.select("trace_id", "span_id", "parent_span_id", F.col("service").alias("name"), F.concat_ws("/", "host", F.coalesce("unit", F.lit("-"))).alias("service"), "unit", span_status("status").alias("status"), span_ending("status").alias("ending"), (F.col("start_us") * 1000).alias("start_ns"), F.round(F.col("elapsed_seconds") * 1e9).cast("bigint").alias("duration_ns"))


#: What a record says beyond the kernel's numbers -> the column that has it.
KNOWN = {"path": "exe", "cmdline": "cmdline", "started_as": "started_as", "unit": "unit"}


def with_known(records: DataFrame, known: DataFrame, on=("host", "pid", "started")) -> DataFrame:
    """Records with what was learned of their processes, each field only where it is not empty; without any of it a record stays as it is."""
    learned = known.select(*on, *[F.nullif(F.col(c), F.lit("")).alias(f"_{k}") for k, c in KNOWN.items()]).dropDuplicates(list(on))
    own = {k: F.coalesce(F.col(k), F.col(f"_{k}")) if k in records.columns else F.col(f"_{k}") for k in KNOWN}
    return records.join(learned, list(on), "left").withColumns(own).drop(*[f"_{k}" for k in KNOWN])
