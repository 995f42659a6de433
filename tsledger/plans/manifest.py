"""Commit manifests: what a version consists of.

A commit is one file ``_log/<number>.json``.  Making that file appear is the commit; data files that no manifest names
are the tail of an unfinished one.  Deletions, annotation operations and metadata are small and stand in the manifest;
rows are Parquet files that it lists with their bounds and hashes.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from ..errors import CorruptedError, NotAStoreError, UnknownCommitError, UnsupportedVersionError
from ..operators.history import ORIGIN, commit_hash
from ..types import DeviceSchema
from .files import Files

LAYOUT = 1
LOG = "_log"
HEAD = "_store.json"


def current(files: Files) -> Files:
    """The folder that holds a store's commits: its own, or that of the generation that has replaced it."""
    if files.exists(HEAD):
        try:
            generation = json.loads(files.read(HEAD)).get("generation")
        except ValueError:
            generation = None
        if generation:
            return Files(files.spark, files.url(generation))
    return files


def name_of(number: int) -> str:
    return f"{LOG}/{number:012d}.json"


@dataclass(frozen=True)
class DataFile:
    """A Parquet file of rows: within it each time stamp occurs once, in order."""

    device: str
    path: str
    rows: int
    t_min: int
    t_max: int
    size: int
    sha256: str


@dataclass(frozen=True)
class CommitChanges:
    devices_created: tuple[str, ...] = ()
    blocks_written: int = 0
    rows_written: int = 0
    ranges_deleted: int = 0
    annotation_ops: int = 0
    metadata_changed: bool = False


@dataclass(frozen=True)
class CommitInfo:
    number: int
    time_ns: int
    author: str | None
    message: str | None
    hash: str
    prev_hash: str
    changes: CommitChanges = field(default_factory=CommitChanges)

    @property
    def time(self) -> dt.datetime:
        return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=self.time_ns // 1000)

    @property
    def short_hash(self) -> str:
        return self.hash[:12]


@dataclass
class Manifest:
    """One commit."""

    number: int
    time_ns: int
    author: str | None = None
    message: str | None = None
    prev_hash: str = ORIGIN
    files: list[DataFile] = field(default_factory=list)
    #: [device, lo, hi, seq]
    deletions: list[list] = field(default_factory=list)
    #: [id, op, device, lo, hi, label, note, seq]
    notes: list[list] = field(default_factory=list)
    devices: list[dict] = field(default_factory=list)
    #: the whole map after the commit; None: unchanged
    metadata: dict[str, str] | None = None
    next_seq: int = 1
    last_note: int = 0
    #: last batch of each streaming query
    streams: dict[str, int] = field(default_factory=dict)
    hash: str = ""

    def body(self) -> bytes:
        own = asdict(self)
        own.pop("hash")
        own["content"] = self.content_hash()
        return json.dumps(own, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()

    def content_hash(self) -> str:
        """Over the hashes of the data files, in order."""
        return hashlib.sha256("\n".join(f"{f.path} {f.sha256}" for f in self.files).encode()).hexdigest()

    def seal(self) -> Manifest:
        self.hash = commit_hash(self.body())
        return self

    def to_text(self) -> str:
        return json.dumps(asdict(self) | {"layout": LAYOUT}, ensure_ascii=False)

    @classmethod
    def from_text(cls, text: str, path: str) -> Manifest:
        try:
            own = json.loads(text)
            layout = own.pop("layout")
            if layout > LAYOUT:
                raise UnsupportedVersionError(f"{path}: layout {layout}")
            own["files"] = [DataFile(**f) for f in own["files"]]
            return cls(**own)
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptedError(f"not a manifest: {e}", path) from e

    def info(self) -> CommitInfo:
        changes = CommitChanges(tuple(d["name"] for d in self.devices), len(self.files), sum(f.rows for f in self.files), len(self.deletions), len(self.notes), self.metadata is not None)
        return CommitInfo(self.number, self.time_ns, self.author, self.message, self.hash, self.prev_hash, changes)


class Catalog:
    """All commits of a store as they were when it was opened."""

    def __init__(self, files: Files, manifests: list[Manifest], origin: str, unfinished: list[str]):
        self.files, self.manifests, self.origin, self.unfinished = files, manifests, origin, unfinished
        self.schemas = {d["name"]: DeviceSchema.from_json(d) for m in manifests for d in m.devices}

    @classmethod
    def open(cls, files: Files) -> Catalog:
        if not files.exists(HEAD):
            raise NotAStoreError(f"{files.root} is not a store")
        try:
            head = json.loads(files.read(HEAD))
        except ValueError as e:
            raise CorruptedError(f"not a store's head: {e}", HEAD) from e
        if head.get("layout", 0) > LAYOUT:
            raise UnsupportedVersionError(f"{files.root}: layout {head['layout']}")
        if "generation" in head:
            return cls.open(Files(files.spark, files.url(head["generation"])))
        names = files.names(LOG)
        own = [n for n in names if n.endswith(".json")]
        manifests = [Manifest.from_text(text, f"{LOG}/{n}") for n, text in zip(own, files.read_all(LOG, own))]
        for k, m in enumerate(manifests, 1):
            if m.number != k:
                raise CorruptedError(f"commit {k} is missing", name_of(k))
        return cls(files, manifests, head["origin"], [f"{LOG}/{n}" for n in names if n.endswith(".tmp")])

    @staticmethod
    def create(files: Files, origin: str = ORIGIN) -> bool:
        return files.publish(HEAD, json.dumps({"layout": LAYOUT, "origin": origin, "created_ns": time.time_ns()}))

    @property
    def head(self) -> int:
        return len(self.manifests)

    @property
    def prev_hash(self) -> str:
        return self.manifests[-1].hash if self.manifests else self.origin

    @property
    def next_seq(self) -> int:
        return self.manifests[-1].next_seq if self.manifests else 1

    @property
    def last_note(self) -> int:
        return max((m.last_note for m in self.manifests), default=0)

    def commit_of(self, seq: int) -> int | None:
        """The number of the commit that a place of the log belongs to: the first that ends beyond it."""
        at = bisect.bisect_right([m.next_seq for m in self.manifests], seq)
        return self.manifests[at].number if at < self.head and seq >= 1 else None

    def upto(self, version: int | None) -> list[Manifest]:
        """Commits of a version: 0 is the empty store, None the head."""
        if version is None:
            return self.manifests
        if not 0 <= version <= self.head:
            raise UnknownCommitError(version)
        return self.manifests[:version]

    def metadata(self, version: int | None = None) -> dict[str, str]:
        return next((dict(m.metadata) for m in reversed(self.upto(version)) if m.metadata is not None), {})

    def streams(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for m in self.manifests:
            out |= m.streams
        return out

    def known_files(self) -> set[str]:
        return {f.path for m in self.manifests for f in m.files}

    def unreferenced(self) -> list[tuple[str, int]]:
        """Data files of no commit, with their sizes: what an unfinished commit left."""
        known = self.known_files()
        return [(n, s) for n, s in self.files.walk("points") if n not in known and not n.rsplit("/", 1)[-1].startswith((".", "_"))]
