"""Tables behind a service that answers by windows of time, as a Spark data source.

The span asked for is tiled by half-open windows, one input partition each.  A page that comes back full may have been cut
off, so its window is halved until no page is full; a window of one second that still fills a page is an error, since losing
rows silently isn't an answer.  What may pass by itself (a busy or broken service) is tried again after growing waits.  A
task that fails is run again by Spark, and since only finished tasks count, no row comes twice.  As a stream, the source's offset is the
time up to which windows have been asked for.

How pages are fetched is a transport, named `module:function` so that executors find it: a function of (lo, hi, limit, options) that
returns an Arrow table of the rows with lo <= time < hi, the earliest `limit` of them.  One marked `opens` is a function of the options that gives such a
function, once for each partition."""

from __future__ import annotations

import bisect
import hashlib
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from quadrille.session import ship
from quadrille.sources.files import NULL_TOKENS
from quadrille.storage import new_path

BUSY = (429, 500, 502, 503, 504)  # answers that may pass by themselves
SECOND = timedelta(seconds=1)


class Unavailable(Exception):
    """The service can't answer now."""


def patiently(call: Callable, attempts: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; while it is `Unavailable` it is tried again, the n-th time after n waits."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Unavailable:
            if n == attempts:
                raise
            sleep(wait * n)


def windows(lo: datetime, hi: datetime, step: timedelta) -> list[tuple[datetime, datetime]]:
    """Half-open windows that tile [lo, hi)."""
    out = []
    while lo < hi:
        out.append((lo, min(lo + step, hi)))
        lo = out[-1][1]
    return out


def pages(fetch: Callable[[datetime, datetime], pa.Table], lo: datetime, hi: datetime, limit: int) -> Iterator[pa.Table]:
    """All rows of a window in time order, from pages none of which was full."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        page = fetch(lo, hi)
        if page.num_rows < limit:
            yield page
            continue
        seconds = int((hi - lo) / SECOND)
        if seconds < 2:
            raise ValueError(f"the page of {lo} is full at {limit} rows; ask for more rows a page")
        middle = lo + (seconds // 2) * SECOND
        todo += [(middle, hi), (lo, middle)]


def named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


# ---- transports ----


def stored(lo: datetime, hi: datetime, limit: int, options: dict) -> pa.Table:
    """Pages out of a Parquet or CSV dataset at `path` with the time column `time`: recorded answers, or a table that stands in for a service."""
    data = pa.dataset.dataset(options["path"], format=options.get("format", "parquet"))
    at = pa.dataset.field(options["time"])
    kind = data.schema.field(options["time"]).type
    inside = (at >= pa.scalar(lo, kind)) & (at < pa.scalar(hi, kind))
    return data.to_table(filter=inside).sort_by(options["time"]).slice(0, limit)


def ordered(options: dict) -> Callable:
    """Opens `stored` for a Parquet folder whose files, by name, and rows are in time order: a page reads the row groups that may hold it, and no more than it gives."""
    files, folder = pyarrow.fs.FileSystem.from_uri(options["path"])
    names = sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    held = []  # least and greatest time of each row group, from footers read once
    for f in (pq.ParquetFile(name, filesystem=files) for name in names):
        column = f.schema_arrow.get_field_index(options["time"])
        stats = [f.metadata.row_group(i).column(column).statistics for i in range(f.metadata.num_row_groups)]
        held += [(x.min.replace(tzinfo=None), x.max.replace(tzinfo=None), f, i) for i, x in enumerate(stats) if x.has_min_max]
    greatest = [g[1] for g in held]
    empty = pq.read_schema(names[0], filesystem=files).empty_table()

    def page(lo: datetime, hi: datetime, limit: int, options: dict) -> pa.Table:
        got, n, k = [empty], 0, bisect.bisect_left(greatest, lo)
        while k < len(held) and held[k][0] < hi and n < limit:
            rows = held[k][2].read_row_group(held[k][3])
            at = rows.column(options["time"])
            got.append(rows.filter(pc.and_(pc.greater_equal(at, pa.scalar(lo, at.type)), pc.less(at, pa.scalar(hi, at.type)))))
            n, k = n + got[-1].num_rows, k + 1
        return pa.concat_tables(got).slice(0, limit)

    return page


ordered.opens = True


def _get(options: dict, **asked) -> bytes:
    url = options["url"].format(**asked)
    headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=float(options.get("timeout", 60))) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if e.code in BUSY:
            raise Unavailable(f"the service answered {e.code}") from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Unavailable(str(e)) from e


def web_csv(lo: datetime, hi: datetime, limit: int, options: dict) -> pa.Table:
    """CSV with a header from `url`, a pattern with {lo}, {hi} and {limit}; options `header.NAME` are sent along."""
    body = _get(options, lo=lo.isoformat(), hi=hi.isoformat(), limit=limit)
    if not body.strip():
        return pa.table({})
    text = pa.csv.ConvertOptions(null_values=list(NULL_TOKENS), strings_can_be_null=True, column_types={c: pa.string() for c in body.split(b"\n", 1)[0].decode().strip().replace('"', "").split(",")})
    return pa.csv.read_csv(pa.BufferReader(body), convert_options=text)


def web_arrays(lo: datetime, hi: datetime, limit: int, options: dict) -> pa.Table:
    """JSON with one array for each column under the key `under`."""
    return pa.table(json.loads(_get(options, lo=lo.isoformat(), hi=hi.isoformat(), limit=limit))[options.get("under", "hourly")])


def web_answer(text: str, options: dict) -> str | None:
    """What `url`, a pattern with {q}, answers to a text; None if nothing."""
    return _get(options, q=urllib.parse.quote(text)).decode() or None


def cached(fetch: Callable, options: dict, clock: Callable[[], float] = time.time) -> Callable:
    """Pages kept in the shared folder `cache`, named by what was asked, and asked for again after `cache_days` days."""
    files, folder = pyarrow.fs.FileSystem.from_uri(options["cache"])
    asked = {k: v for k, v in options.items() if not k.startswith("cache")}

    def get(lo: datetime, hi: datetime, limit: int, options: dict) -> pa.Table:
        name = hashlib.sha256(json.dumps([str(lo), str(hi), limit, sorted(asked.items())]).encode()).hexdigest()
        path = f"{folder}/{name}.arrow"
        info = files.get_file_info(path)
        if info.is_file and clock() - info.mtime.timestamp() < float(options.get("cache_days", 30)) * 86400:
            with files.open_input_file(path) as f:
                return pa.ipc.open_file(f).read_all()
        page = fetch(lo, hi, limit, options)
        files.create_dir(folder, recursive=True)
        part = f"{path}.{time.time_ns()}"
        with files.open_output_stream(part) as f, pa.ipc.new_file(f, page.schema) as out:
            out.write_table(page)
        files.move(part, path)  # whole or not there at all
        return page

    return get


def in_time_order(df: DataFrame, time: str, group_rows: int = 8192) -> str:
    """Where the rows now lie for `ordered`: dealt by ranges of time, sorted, in row groups of which a page needs few."""
    path = new_path(df.sparkSession, "by-time")
    df.repartitionByRange(time).sortWithinPartitions(time).write.option("parquet.block.row.count.limit", group_rows).parquet(path)
    return path


# ---- the data source ----


@dataclass
class TimeWindow(InputPartition):
    lo: datetime
    hi: datetime


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, dict(options)
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))
        self.step, self.limit = timedelta(hours=float(options.get("window_hours", 24))), int(options.get("page_rows", 50_000))

    def tiles(self, lo: datetime, hi: datetime) -> list[TimeWindow]:
        return [TimeWindow(a, b) for a, b in windows(lo, hi, self.step)]

    def read(self, partition: TimeWindow) -> Iterator[pa.RecordBatch]:
        o = self.options
        get = named(o["transport"])
        get = get(o) if getattr(get, "opens", False) else get
        get = cached(get, o) if "cache" in o else get
        ask = lambda lo, hi: patiently(lambda: get(lo, hi, self.limit, o), int(o.get("attempts", 5)), float(o.get("wait_seconds", 2)))
        want = to_arrow_schema(self.schema)
        for page in pages(ask, partition.lo, partition.hi, self.limit):
            if page.num_rows:
                cols = [page.column(f.name).cast(f.type) if f.name in page.column_names else pa.nulls(page.num_rows, f.type) for f in want]
                yield from pa.Table.from_arrays(cols, schema=want).to_batches()


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[TimeWindow]:
        return self.tiles(self.start, self.end) or [TimeWindow(self.start, self.start + SECOND)]


class PagedStream(_Pages, DataSourceStreamReader):
    """Everything up to `end` or now, whichever is earlier; offsets are times."""

    def initialOffset(self) -> dict:
        return {"at": self.start.isoformat()}

    def latestOffset(self) -> dict:
        now = datetime.fromtimestamp(int(time.time()))
        return {"at": max(self.start, min(self.end, now)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[TimeWindow]:
        return self.tiles(datetime.fromisoformat(start["at"]), datetime.fromisoformat(end["at"]))

    def commit(self, end: dict) -> None:
        """Nothing is held back for a restart: windows are asked for again."""


class PagedSource(DataSource):
    """Format `paged`: options start, end (ISO times), transport, window_hours, page_rows, attempts, wait_seconds, cache, cache_days and what the transport needs; the schema is given."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(PagedSource)
    return spark


def ask_each(queries: DataFrame, column: str, answer: str, transport: str, options: dict[str, str], threads: int = 8) -> DataFrame:
    """The rows with what a service answers to each text of `column` (null where it knows nothing), `threads` questions of a task at a time.

    The transport is a function of (text, options) that gives a text or None.  Null texts aren't asked."""
    ship(queries.sparkSession)
    o = dict(options)

    def run(batches):
        get = named(transport)
        one = lambda q: None if q is None else patiently(lambda: get(q, o), int(o.get("attempts", 5)), float(o.get("wait_seconds", 2)))
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                asked = batch.column(batch.schema.get_field_index(column)).to_pylist()
                distinct = list(dict.fromkeys(asked))
                got = dict(zip(distinct, pool.map(one, distinct)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([got[q] for q in asked], pa.string())], names=[*batch.schema.names, answer])

    return queries.mapInArrow(run, f"{queries.schema.simpleString()[7:-1]},{answer}:string")
