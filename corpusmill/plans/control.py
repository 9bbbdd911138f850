"""Checks that a driver makes before a run, and the seams where recorded tables stand in for services."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BATCH_STATES, FROZEN, TRUTH_POLICIES
from ..operators.acquire import estimated_calls

MODES = ("production", "flow_testing")


class ControlError(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ControlError(message)


def check_mode(mode: str | None, sheet: str | None) -> None:
    """A replaying run needs its sheet."""
    need(mode in MODES, f"mode must be one of {MODES}, got {mode!r}")
    need(mode != "flow_testing" or bool(sheet), "flow_testing needs a calibration sheet")


def parse_combo(spec: str, builds: Sequence[str], providers: Sequence[str]) -> tuple[str, str]:
    """'build:provider', in any case."""
    build, colon, provider = (p.strip().lower() for p in spec.partition(":"))
    need(bool(colon) and build in builds and provider in providers, f"{spec!r} is not one of {builds} and one of {providers}, joined by a colon")
    return build, provider


def parse_stage(spec: str, builds: Sequence[str], providers: Sequence[str]) -> tuple[str, bool]:
    """'build:provider' or 'build:provider?advisory' -> (combo, advisory), as a cascade takes it."""
    combo, _, flag = spec.partition("?")
    need(flag in ("", "advisory"), f"unknown flag {flag!r}")
    return ":".join(parse_combo(combo, builds, providers)), flag == "advisory"


def check_roles(subject: Mapping | None, manager: Mapping | None) -> None:
    """The two model hosts are there and share no address, log or cache."""
    need(bool(subject) and bool(manager), "both roles must be configured")
    shared = [k for k in ("base_url", "log_path", "cache_path") if subject.get(k) == manager.get(k)]
    need(not shared, f"the roles must not share {', '.join(shared)}")


def check_window(window: Mapping | None, fields: Sequence[str]) -> dict | None:
    if window is None:
        return None
    unknown = sorted(set(window) - set(fields))
    need(not unknown, f"unknown window fields: {unknown}")
    skipped = window.get("exclude_arxiv_ids")
    need(skipped is None or (isinstance(skipped, list) and all(isinstance(x, str) and x.strip() for x in skipped)), "exclude_arxiv_ids must be a list of identifiers")
    return dict(window)


@dataclass
class Plan:
    """An acquisition: what is wanted, what it may cost, who approved it."""

    run_id: str
    target_count: int
    call_budget: int
    mode: str = "production"
    extraction: str = "abstract"
    output_dir: str = ""
    truth_policy: str | None = None
    sheet: str | None = None
    approved_by: str | None = None
    approved_at: str | None = None

    def approve(self, by: str, now: datetime | None = None) -> Plan:
        return Plan(**{**self.__dict__, "approved_by": by, "approved_at": (now or datetime.now(timezone.utc)).isoformat()})

    def check(self) -> None:
        """Everything that must hold before the first paid call; the budget must cover the estimate."""
        check_mode(self.mode, self.sheet)
        need(bool(self.approved_by and self.approved_at), "the plan is not approved")
        need(bool(self.run_id) and bool(self.output_dir), "run_id and output_dir must be set")
        whole = isinstance(self.target_count, int) and isinstance(self.call_budget, int) and not isinstance(self.call_budget, bool)
        need(whole and self.target_count > 0 and self.call_budget >= 0, "target_count and call_budget must be whole numbers")
        need(self.truth_policy is None or self.truth_policy in TRUTH_POLICIES, f"unknown truth policy {self.truth_policy!r}")
        wanted = estimated_calls(self.target_count, self.extraction)
        need(self.mode != "production" or wanted <= self.call_budget, f"the budget of {self.call_budget} calls is below the estimate of {wanted}")


def check_not_retired(path: str, retired: Sequence[str]) -> None:
    """No retired location is read or written again."""
    bad = [r for r in retired if os.path.normpath(path) == os.path.normpath(r) or os.path.normpath(path).startswith(os.path.normpath(r) + os.sep)]
    need(not bad, f"{path} is retired: {bad}")


def check_baseline(spark: SparkSession, path: str, uids: DataFrame) -> None:
    """A baseline's scores are there, and for every uid, before anything is trained."""
    try:
        scores = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ControlError(f"no baseline at {path}") from e
    lost = uids.select("uid").join(scores.where("n_correct is not null").select("uid"), "uid", "left_anti").limit(5).collect()
    need(not lost, f"no baseline score for {[r.uid for r in lost]}")


def check_chain(spark: SparkSession, manifest: Mapping[str, str], paths: Mapping[str, str]) -> None:
    """Each file that a manifest names by its SHA-256 is that very file."""
    unnamed = sorted(set(paths) - set(manifest))
    need(not unnamed, f"the manifest does not name {unnamed}")
    wrong = [name for name, path in paths.items() if pin(spark, path)[0] != manifest[name]]
    need(not wrong, f"not the files of the manifest: {wrong}")


def run_concluded(marker: bool, quiet_seconds: float | None, limit_seconds: float) -> bool:
    """A run has ended if it left its marker, or if nothing was written for so long."""
    return marker or (quiet_seconds is not None and quiet_seconds >= limit_seconds)


def tick(watch: Sequence[Callable], batches: Sequence[Batch], advance: Callable[[int], None], slice_new: Callable) -> str:
    """One step of the loop: other journals are read, a frozen batch halts it, the oldest unfinished batch moves on by one stage, else a new slice is cut."""
    for read in watch:
        read()
    if any(b.state == FROZEN for b in batches):
        return "halted"
    for k, b in enumerate(batches):
        if b.state != BATCH_STATES[-1]:
            advance(k)
            return "advanced"
    slice_new()
    return "sliced"


def status_report(batches: Mapping[int, Batch], held: int, extras: Mapping[str, object] | None = None) -> str:
    """Markdown: batches by number with their states and last change, the rows that wait for a slice, and what else a run tells."""
    rows = [f"| {k} | {b.state or 'none'} | {b.history[-1][2] if b.history else ''} |" for k, b in sorted(batches.items())]
    more = [f"- {k}: {v}" for k, v in (extras or {}).items()]
    return "\n".join(["# Status", "", "| batch | state | since |", "| --- | --- | --- |", *rows, "", f"Rows held for the next slice: {held}", "", *more])


def retry_after(value: str | None) -> float | None:
    """Seconds of a Retry-After header that gives a number; null for a date or anything else."""
    try:
        seconds = float(value) if value is not None else None
    except ValueError:
        return None
    return seconds if seconds is not None and 0 <= seconds < float("inf") else None


def check_names(paths: Sequence[str], blocked: Sequence[str]) -> None:
    """No file's name holds a blocked part."""
    bad = [p for p in paths for b in blocked if b in os.path.basename(p).lower()]
    need(not bad, f"blocked names: {bad}")


def pin(spark: SparkSession, path: str) -> tuple[str, int]:
    """(SHA-256, rows) of a line file, the last line counted whether it ends or not. The file is streamed, the lines are counted by Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        sha = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    return sha, spark.read.option("lineSep", "\n").text(path).count()


def check_pin(spark: SparkSession, path: str, sha256: str, rows: int) -> None:
    got = pin(spark, path)
    need(got == (sha256, rows), f"{path}: pinned {sha256[:16]} with {rows} rows, found {got[0][:16]} with {got[1]}")


@dataclass
class Batch:
    """A batch's state and how it got there."""

    state: str | None = None
    history: list[tuple[str | None, str, str]] = field(default_factory=list)

    def to(self, state: str, now_iso: str) -> Batch:
        """One step on; any but the last state can freeze, and a frozen batch can go to any state. The same state is no step."""
        need(state in (*BATCH_STATES, FROZEN), f"unknown state {state!r}")
        if state == self.state:
            return self
        if state == FROZEN:
            need(self.state != BATCH_STATES[-1], "a finished batch can't freeze")
        elif self.state is None:
            need(state == BATCH_STATES[0], f"the first state is {BATCH_STATES[0]}")
        elif self.state != FROZEN:
            need(BATCH_STATES.index(state) == BATCH_STATES.index(self.state) + 1, f"no step from {self.state} to {state}")
        return Batch(state, [*self.history, (self.state, state, now_iso)])


def with_retries(call: Callable, retryable: Callable[[Exception], bool], attempts: int = 3):
    """The call's result; the last error once the attempts are used up or an error is final."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as e:
            if not left or not retryable(e):
                raise


class ReplayTable:
    """A service's recorded answers: requests are joined, never sent."""

    def __init__(self, answers: DataFrame, keys: Sequence[str]) -> None:
        self.answers, self.keys = answers, list(keys)

    def ask(self, requests: DataFrame) -> DataFrame:
        """requests with the answers' columns, null where nothing is recorded."""
        return requests.join(self.answers, self.keys, "left")

    def ask_all(self, requests: DataFrame) -> DataFrame:
        """As ask; a request without a recorded answer is an error."""
        lost = requests.join(self.answers, self.keys, "left_anti").select(*self.keys).limit(5).collect()
        need(not lost, f"no recorded answer for {[tuple(r) for r in lost]}")
        return self.ask(requests)


def backend(mode: str, answers: DataFrame | None, keys: Sequence[str] = ("uid", "sample_idx")) -> ReplayTable:
    """The only backend is a recorded table: live calls are never on."""
    need(answers is not None, f"{mode}: no recorded answers; live backends are not built here")
    return ReplayTable(answers, keys)


def source_report(title: str, counts: Mapping[str, int], warnings: DataFrame, quarantine: DataFrame) -> str:
    """Markdown: outcome first, then warnings and reasons by count."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in counts.items()), ""]
    for name, df, column in (("Warnings", warnings, "warning"), ("Quarantine", quarantine, "quarantine_reason")):
        rows = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(50).collect()
        lines += [f"## {name}", "", *(f"- {r[column]}: {r.n}" for r in rows), ""]
    return "\n".join(lines)
