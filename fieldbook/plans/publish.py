"""Staged publication of tables and their reports.

A version is written to a folder of its own below its target, read back and
validated; then a pointer that names it is made, in one step. A writer holds a
lease: a numbered file, made exclusively, with its owner and its expiry. A lease
that was given back, or that a dead writer let expire, is followed by the next
number, so nobody waits for long. Pointers carry the number of the lease under
which they were made, and the highest number counts: a writer that wakes up after
another has published makes a pointer that no reader follows. Old versions stay
where they are, and a run that fails leaves the published one as it was. All paths
go through Hadoop's file systems; the store must create a file exclusively and
rename it in one step, as HDFS and shared POSIX folders do and plain object stores
don't.
"""

from __future__ import annotations

import contextlib
import json
import socket
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators.curate import report


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: to a name of its own first, which then takes the place of ``path`` in one step."""
    fs, at, make = _fs(spark, path)
    part = make(f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    at, part = fs.makeQualified(at), fs.makeQualified(part)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


#: Seconds for which a lease is held unless it is renewed.
LEASE_SECONDS = 3600.0


@dataclass(frozen=True)
class Lease:
    """The right to publish at a target until it expires, or another lease follows it."""

    spark: SparkSession
    target: str
    number: int
    owner: str

    @property
    def path(self) -> str:
        return f"{self.target}/LEASES/{self.number:012d}"

    def renew(self, seconds: float = LEASE_SECONDS) -> None:
        """Hold on for longer. Raises RuntimeError if another lease has followed."""
        self.check()
        write_text(self.spark, self.path, to_json({"owner": self.owner, "expires": time.time() + seconds}))

    def check(self) -> None:
        """Raise RuntimeError if another lease has followed this one."""
        if (last := _last(self.spark, f"{self.target}/LEASES/")) != self.number:
            raise RuntimeError(f"the lease {self.number} on {self.target} has expired and was followed by {last}")

    def give_back(self) -> None:
        """Let the next writer begin at once."""
        if _last(self.spark, f"{self.target}/LEASES/") == self.number:
            write_text(self.spark, self.path, to_json({"owner": self.owner, "expires": 0}))


def _last(spark: SparkSession, prefix: str) -> int | None:
    """The highest number of the files whose path is ``prefix`` and a number; None if there are none."""
    fs, at, _ = _fs(spark, f"{prefix}*")
    found = fs.globStatus(at) or []
    names = [str(f.getPath().getName()).removeprefix(prefix.rsplit("/", 1)[-1]) for f in found]
    return max((int(n) for n in names if n.isdigit()), default=None)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file exclusively; False if there is one. It appears whole: written aside and moved without replacing."""
    fs, at, make = _fs(spark, path)
    part = make(f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    at, part = fs.makeQualified(at), fs.makeQualified(part)
    claim = make(f"{path}.claim")  # exclusive also where a rename replaces what is there
    try:
        fs.create(claim, False).close()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, how)
    except Exception:  # the JVM's error, whose kind depends on the store
        fs.delete(part, False)
        if fs.exists(claim):
            return False
        raise
    return True


def acquire(spark: SparkSession, target: str, seconds: float = LEASE_SECONDS, owner: str | None = None) -> Lease:
    """The next lease on ``target``. Raises FileExistsError while another writer holds one, or if one was faster."""
    last = _last(spark, f"{target}/LEASES/")
    if last is not None:
        held = json.loads(read_text(spark, f"{target}/LEASES/{last:012d}"))
        if held["expires"] > time.time():
            raise FileExistsError(f"{held['owner']} holds the lease {last} on {target}")
    lease = Lease(spark, target, (last or 0) + 1, owner or f"{socket.gethostname()}-{uuid.uuid4().hex[:8]}")
    for _ in range(3):  # a writer that died between claiming a number and making its file leaves that number out
        if _create(spark, lease.path, to_json({"owner": lease.owner, "expires": time.time() + seconds})):
            return lease
        if _last(spark, f"{target}/LEASES/") != last:
            break
        time.sleep(1)  # the claim's own file may be under way
        if _last(spark, f"{target}/LEASES/") != last:
            break
        lease = Lease(spark, target, lease.number + 1, lease.owner)
    raise FileExistsError(f"another run was faster to take a lease on {target}")


@contextlib.contextmanager
def leased(spark: SparkSession, target: str, seconds: float = LEASE_SECONDS):
    """Hold a lease on ``target``, given back at the end."""
    lease = acquire(spark, target, seconds)
    try:
        yield lease
    finally:
        lease.give_back()


def point(lease: Lease, name: str) -> None:
    """Make ``name`` the current version. Raises RuntimeError, and changes nothing that a reader sees, if the lease has been followed."""
    lease.check()
    made = _create(lease.spark, f"{lease.target}/CURRENT-{lease.number:012d}", name)
    if not made or _last(lease.spark, f"{lease.target}/CURRENT-") != lease.number:
        raise RuntimeError(f"{lease.target} has a version of a later lease than {lease.number}")


def to_json(value) -> str:
    """Deterministic JSON: sorted keys, two spaces."""
    return json.dumps(value, sort_keys=True, indent=2, default=str, ensure_ascii=False) + "\n"


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the published version; None if there is none."""
    number = _last(spark, f"{target}/CURRENT-")
    name = None if number is None else read_text(spark, f"{target}/CURRENT-{number:012d}")
    return f"{target}/{name.strip()}" if name else None


def published(spark: SparkSession, target: str) -> DataFrame:
    """The published version."""
    if (path := current(spark, target)) is None:
        raise FileNotFoundError(f"nothing is published at {target}")
    return spark.read.parquet(path)


def publish(frame: DataFrame, target: str, validate: Callable[[DataFrame], None], replace: bool = False, seconds: float = LEASE_SECONDS) -> str | None:
    """Publish ``frame`` as Parquet at ``target``; returns the folder of the version that it replaces, if there was one.

    ``validate`` gets the staged table, read back, and raises if it is wrong.
    Readers go through :func:`published`.
    """
    spark = frame.sparkSession
    with leased(spark, target, seconds) as lease:
        before = current(spark, target)
        if before and not replace:
            raise FileExistsError(f"{target} is published; pass replace=True to publish a new version")
        name = f"version-{uuid.uuid4().hex}"
        frame.write.parquet(f"{target}/{name}")
        validate(spark.read.schema(frame.schema).parquet(f"{target}/{name}"))
        point(lease, name)
    return before


def curated_export(decisions: DataFrame, made: DataFrame, target: str, version: str, source: Callable[[], str]) -> dict:
    """Publish a curated dataset: its samples as JSON lines, ``metadata.json`` and ``report.json``, and a pointer to their folder.

    ``source`` gives the hash of the source's bytes; it must be the same after
    the export as before. The samples are read back: as many as were kept, no
    path or content twice, and paths with content as decided.
    """
    spark, before = decisions.sparkSession, source()
    measures = {r["measure"]: r["value"] for r in report(decisions).collect()}
    with leased(spark, target) as lease:
        name = f"version-{uuid.uuid4().hex}"
        made.write.json(f"{target}/{name}/samples.json")
        staged = spark.read.schema("path string, sha256 string").json(f"{target}/{name}/samples.json")
        n, paths, hashes = staged.agg(F.count(F.lit(1)), F.count_distinct("path"), F.count_distinct("sha256")).first()
        if not n == paths == hashes == measures["kept"]:
            raise ValueError(f"staged export has {n} samples, {paths} paths and {hashes} contents; {measures['kept']} were kept")
        wanted = decisions.where("decision <> 'drop'").select("path", "sha256")
        if not staged.exceptAll(wanted).isEmpty():
            raise ValueError("staged export holds samples that were not decided on")
        write_text(spark, f"{target}/{name}/metadata.json", to_json({"version": version, "samples": n, "source_sha256": before}))
        write_text(spark, f"{target}/{name}/report.json", to_json(measures))
        if source() != before:
            raise RuntimeError("the source changed while it was exported")
        point(lease, name)
    return measures


def export_embeddings(rows: DataFrame, target: str) -> dict:
    """Write (path, label, embedding, and whatever else) as Parquet, and ``metadata.json`` with rows, labels and the embeddings' size; returns that."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{target}/embeddings")
    stored = spark.read.schema(rows.schema).parquet(f"{target}/embeddings")
    n, labels, least, most = stored.agg(F.count(F.lit(1)), F.count_distinct("label"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    told = {"rows": n, "labels": labels, "embedding_shape": [n, least] if least == most else None, "columns": rows.columns}
    write_text(spark, f"{target}/metadata.json", to_json(told))
    return told


def checkpoint_export(rows: DataFrame, target: str, without: tuple[str, ...] = ("content",)) -> dict:
    """A copy of a table without its media, and ``manifest.json`` with its rows, fields and a checksum over all rows; returns that."""
    spark, kept = rows.sparkSession, rows.drop(*without)
    kept.write.mode("overwrite").parquet(f"{target}/rows")
    stored = spark.read.schema(kept.schema).parquet(f"{target}/rows")
    n, total = stored.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()
    told = {"rows": n, "fields": kept.columns, "checksum": str(total or 0)}
    write_text(spark, f"{target}/manifest.json", to_json(told))
    return told


def same_rows(expected: int, key: str) -> Callable[[DataFrame], None]:
    """A validation: as many rows as expected, and the key unique and never null."""

    def check(staged: DataFrame) -> None:
        n, keys = staged.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if (n, keys) != (expected, expected):
            raise ValueError(f"staged table has {n} rows and {keys} keys; expected {expected}")

    return check


def export_variants(samples: DataFrame, target: str, variants: dict[str, DataFrame], fields: list[str] | None = None, identity: tuple[str, ...] = ("jaguar_id", "ground_truth")) -> dict[str, int]:
    """Write each variant below ``target`` (given fields and always the identity's); returns rows by variant."""
    counts = {}
    for name, view in variants.items():
        if fields:
            view = view.select(*[c for c in view.columns if c in fields or c in identity])
        view.write.mode("overwrite").parquet(f"{target}/{name}")
        counts[name] = view.sparkSession.read.schema(view.schema).parquet(f"{target}/{name}").count()
    return counts


PHASES = ("audit", "stage", "validate", "publish", "done")


@dataclass
class RunReport:
    """What a run did, as far as it came."""

    name: str
    phase: str = PHASES[0]
    counts: dict = field(default_factory=dict)
    failure: str | None = None
    started: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def at(self, phase: str, **counts) -> RunReport:
        if phase not in PHASES or PHASES.index(phase) < PHASES.index(self.phase):
            raise ValueError(f"cannot go from {self.phase} to {phase}")
        self.phase, self.counts = phase, self.counts | counts
        return self

    def failed(self, error: Exception) -> RunReport:
        self.failure = f"{type(error).__name__}: {error}"
        return self

    def write(self, spark: SparkSession, folder: str) -> str:
        """A timestamped report, and the same as ``latest.json``."""
        text = to_json(asdict(self))
        path = f"{folder}/{self.name}-{self.started.replace(':', '')}.json"
        write_text(spark, path, text)
        write_text(spark, f"{folder}/latest.json", text)
        return path


def snapshot_run(frame: DataFrame, target: str, key: str, reports: str, dry_run: bool = True, replace: bool = False) -> RunReport:
    """Audit, and unless ``dry_run`` stage, validate and publish a snapshot; the report is written even if the run fails."""
    spark, told = frame.sparkSession, RunReport("snapshot")
    try:
        n = frame.count()
        told.at("audit", rows=n)
        if not dry_run:
            told.at("stage")
            retired = publish(frame, target, same_rows(n, key), replace)
            told.at("done", retired=retired)
    except Exception as error:
        told.failed(error)
        raise
    finally:
        told.write(spark, reports)
    return told
