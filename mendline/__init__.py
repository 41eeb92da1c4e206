"""Block-hash table synchronisation on Spark."""

from .plans.sync import TableSync
from .schema import SALES, sales_schema
from .scratch import clear_scratch
from .sources.file_log import FileLog
from .sources.header_log import HeaderLog
from .sources.result_log import ResultLog
from .sources.snapshot import CommitConflict, SnapshotTable
from .sources.table import BlockTable
from .streaming.header_stream import HeaderStream

__all__ = ["SALES", "BlockTable", "CommitConflict", "FileLog", "HeaderLog", "HeaderStream", "ResultLog", "SnapshotTable", "TableSync", "clear_scratch", "sales_schema"]
