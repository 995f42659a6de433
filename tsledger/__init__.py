"""tsledger: versioned time-series tables on PySpark.

Each device is a table keyed by time.  Writes, deletions and labelled intervals are appended in atomic, hash-chained
commits; every earlier version stays readable as an ordinary DataFrame.
"""

from .edit import Transaction, WriteOptions, Writer, device_schema
from .errors import (
    CorruptedError,
    DeviceExistsError,
    InvalidArgumentError,
    LedgerError,
    LimitExceededError,
    LockedError,
    NotAStoreError,
    NotFinalizedError,
    PointNotFoundError,
    SchemaError,
    TypeMismatchError,
    UnknownAnnotationError,
    UnknownColumnError,
    UnknownCommitError,
    UnknownDeviceError,
    UnsupportedError,
    UnsupportedVersionError,
)
from .functions.encodings import Encoding, EncodingPolicy
from .functions.timeconv import format_time, to_datetime, to_raw
from .maintenance import CompactReport, RecoverReport, VerifyReport, compact, recover, verify
from .plans.manifest import CommitChanges, CommitInfo
from .sources.batch import Batch, Column
from .store import Annotation, AnnotationChange, BlockInfo, Diff, File, PointChange, Query, Reader, create, iter_batches, open, read, read_arrow, read_batches, read_pandas, read_polars, write  # noqa: A004
from .types import ColumnSchema, DataType, DeviceSchema, TimeUnit

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_")]
