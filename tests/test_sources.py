"""The paged source and the bundle sink: recorded pages, full pages, busy services, streams, aborted jobs."""

import http.server
import json
import threading
import urllib.parse
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille.sources import bundle, paged

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    """Three days with a very busy hour, some of them at window borders."""
    path = tmp_path_factory.mktemp("recorded")
    at = [START + timedelta(minutes=7 * i) for i in range(600)] + [START + timedelta(hours=30, seconds=i) for i in range(900)]
    pq.write_table(pa.table({"id": pa.array(range(len(at))), "at": pa.array(at, pa.timestamp("us")), "speed": pa.array([float(i % 50) for i in range(len(at))])}), f"{path}/a.parquet")
    return str(path), at


def load(spark, recorded, **more):
    options = {"transport": "quadrille.sources.paged:stored", "path": recorded[0], "time": "at", "start": START.isoformat(), "end": (START + timedelta(days=3)).isoformat(), "window_hours": 5, "page_rows": 100}
    return paged.register(spark).read.format("paged").schema("id long, at timestamp_ntz, speed double, note string").options(**{**options, **more}).load()


def test_full_pages_are_split_and_no_row_is_lost(spark, recorded):
    df = load(spark, recorded)
    assert sorted(r.id for r in df.collect()) == list(range(len(recorded[1]))) and df.rdd.getNumPartitions() == 15
    assert df.filter("note is not null").count() == 0
    got = load(spark, recorded, end=(START + timedelta(hours=7)).isoformat()).collect()
    assert sorted(r.id for r in got) == [i for i, t in enumerate(recorded[1]) if t < START + timedelta(hours=7)]
    assert load(spark, recorded, end=START.isoformat()).count() == 1  # a span without windows asks for its first second
    with pytest.raises(Exception, match="full at 2 rows"):
        pages = paged.pages(lambda lo, hi: pa.table({"x": [1, 2]}), START, START + timedelta(seconds=8), 2)
        list(pages)


def test_windows_tile_and_pages_come_in_order():
    tiles = paged.windows(START, START + timedelta(hours=7), timedelta(hours=3))
    assert [int((b - a).total_seconds()) for a, b in tiles] == [10800, 10800, 3600] and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))
    rows = [START + timedelta(seconds=s) for s in (0, 1, 1, 2, 5, 9, 9, 9)]
    fetch = lambda lo, hi: pa.table({"at": pa.array([t for t in rows if lo <= t < hi][:4], pa.timestamp("us"))})
    assert [t for p in paged.pages(fetch, START, START + timedelta(seconds=10), 4) for t in p.column(0).to_pylist()] == rows


def test_waits_grow_and_end():
    waits, answers = [], iter([paged.Unavailable("busy"), paged.Unavailable("busy"), "rows"])

    def call():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert paged.patiently(call, 5, 2.0, waits.append) == "rows" and waits == [2.0, 4.0]
    with pytest.raises(paged.Unavailable):
        paged.patiently(lambda: (_ for _ in ()).throw(paged.Unavailable("busy")), 3, 1.0, waits.append)
    assert waits == [2.0, 4.0, 1.0, 2.0]
    with pytest.raises(KeyError):  # what doesn't pass by itself isn't tried again
        paged.patiently(lambda: {}["x"], 3, 1.0, waits.append)
    assert len(waits) == 4


@pytest.fixture
def service(recorded):
    """An HTTP service that is busy at every third request."""
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if len(asked) % 3 == 1:
                self.send_error(503)
                return
            if self.path.startswith("/ask"):
                text = urllib.parse.unquote(self.path.split("=")[1])
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b"" if text == "nowhere" else f"at {text}".encode())
                return
            q = dict(p.split("=") for p in self.path.split("?")[1].split("&"))
            lo, hi = datetime.fromisoformat(q["lo"]), datetime.fromisoformat(q["hi"])
            rows = sorted((t, i) for i, t in enumerate(recorded[1]) if lo <= t < hi)[: int(q["limit"])]
            if self.path.startswith("/csv"):
                body = "id,at,speed\n" + "".join(f"{i},{t.isoformat()},{'NA' if i % 5 == 0 else i}\n" for t, i in rows)
            else:
                body = json.dumps({"hourly": {"id": [i for _, i in rows], "speed": [float(i) for _, i in rows]}})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_a_busy_service_over_http_with_a_cache(spark, recorded, service, tmp_path):
    url, asked = service
    more = {"transport": "quadrille.sources.paged:web_csv", "url": url + "/csv?lo={lo}&hi={hi}&limit={limit}", "wait_seconds": "0.01", "cache": str(tmp_path / "cache"), "window_hours": 24, "page_rows": 400}
    got = {r.id: r for r in load(spark, recorded, **more).collect()}
    assert set(got) == set(range(len(recorded[1]))) and got[5].speed is None and got[7].speed == 7.0 and got[7].at == recorded[1][7]
    before = len(asked)
    assert load(spark, recorded, **more).count() == len(got) and len(asked) == before  # from the cache
    o = {"cache": str(tmp_path / "old"), "cache_days": "30"}
    calls = []
    for clock in (0, 1, 31):
        get = paged.cached(lambda *a: calls.append(1) or pa.table({"x": [1]}), o, lambda c=clock: __import__("time").time() + c * 86400)
        assert get(START, START, 5, o).num_rows == 1
    assert len(calls) == 2
    arrays = load(spark, recorded, transport="quadrille.sources.paged:web_arrays", url=url + "/json?lo={lo}&hi={hi}&limit={limit}", wait_seconds="0.01", window_hours=72, page_rows=5000)
    assert sorted(r.id for r in arrays.collect()) == sorted(got)


def test_stream_goes_on_from_its_offset(spark, recorded, tmp_path):
    paged.register(spark)

    def run(end):
        q = spark.readStream.format("paged").schema("id long, at timestamp_ntz, speed double").options(transport="quadrille.sources.paged:stored", path=recorded[0], time="at", start=START.isoformat(), end=end.isoformat(), window_hours=12, page_rows=100).load()
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(START + timedelta(hours=20)) == [i for i, t in enumerate(recorded[1]) if t < START + timedelta(hours=20)]
    assert run(START + timedelta(days=3)) == list(range(len(recorded[1])))


def test_each_text_of_a_batch_is_asked_once(spark, service):
    url, asked = service
    rows = spark.createDataFrame([(1, "a&b"), (2, "a&b"), (3, None), (4, "nowhere"), (5, "é")], "id int, place string").coalesce(1)
    got = paged.ask_each(rows, "place", "found", "quadrille.sources.paged:web_answer", {"url": url + "/ask?q={q}", "wait_seconds": "0.01"}, threads=2)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a&b", "at a&b"), (2, "a&b", "at a&b"), (3, None, None), (4, "nowhere", None), (5, "é", "at é")]
    assert 3 <= len(asked) <= 6  # and again after each busy answer


# ---- bundles ----


def tensor(spark, n=230):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") / 7).alias("x"), F.array(*(F.col("id") * i + 0.5 for i in range(3))).alias("m"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id)").alias("ts")).repartitionByRange(4, "k").sortWithinPartitions("k")


def test_bundle_read_back_by_numpy(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle.write_bundle(tensor(spark), path, {"tag": "t"}, shard_rows=50)
    about = bundle.description(path)
    assert about["tag"] == "t" and sum(about["rows"]) == 230 and max(about["rows"]) <= 50 and about["columns"]["m"]["shape"] == [230, 3]
    whole = {c: np.concatenate([np.load(f"{path}/{c}.{i:06d}.npy") for i in range(len(about["rows"]))]) for c in about["columns"]}
    assert (whole["k"] == np.arange(230)).all() and np.allclose(whole["m"], np.arange(230)[:, None] * np.arange(3) + 0.5) and whole["k"].dtype == np.int32
    back = bundle.read_bundle(spark, path).orderBy("position").collect()
    assert [(r.position, r.k, list(r.m)) for r in back] == [(i, i, [0.5, i + 0.5, 2 * i + 0.5]) for i in range(230)]
    assert not list((tmp_path / "b").glob("_staging*"))
    with pytest.raises(Exception, match="there is a bundle"):
        bundle.write_bundle(tensor(spark), path)
    bundle.write_bundle(tensor(spark, 7), path, overwrite=True)
    assert sum(bundle.description(path)["rows"]) == 7 and len(list((tmp_path / "b").glob("x.*.npy"))) == len(bundle.description(path)["rows"])
    bundle.write_bundle(tensor(spark, 0), path, overwrite=True)
    assert bundle.description(path)["rows"] == [] and bundle.read_bundle(spark, path).count() == 0


@pytest.mark.parametrize("fault, message", [("if(id = 199, null, id)", "nulls"), ("if(id = 199, array(1), array(1, 2))", "length"), ("cast(id as string)", "neither"), ("if(id < 100, array(1), array(1, 2))", "length|differ"), ("if(id = 199, raise_error('lost'), id)", "lost")])
def test_an_aborted_job_leaves_nothing(spark, tmp_path, fault, message):
    path = tmp_path / "b"
    with pytest.raises(Exception, match=message):
        bundle.write_bundle(spark.range(200).selectExpr("id", f"{fault} as v").repartitionByRange(4, "id").sortWithinPartitions("id"), str(path), shard_rows=10)
    assert not list(path.glob("**/*.npy")) and not (path / "meta.json").exists()


def test_pages_in_time_order_read_what_they_give(spark, recorded):
    rows = spark.read.parquet(recorded[0]).repartition(3)
    path = paged.in_time_order(rows, "at", 50)
    got = load(spark, (path, recorded[1]), transport="quadrille.sources.paged:ordered").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, load(spark, recorded).collect())) and len(got) == len(recorded[1])
    options = {"path": path, "time": "at"}
    page = paged.ordered(options)
    for lo, hi, limit in ((START, START + timedelta(days=3), 40), (START + timedelta(hours=30), START + timedelta(hours=31), 1000), (START - timedelta(days=2), START, 5)):
        want = paged.stored(lo, hi, limit, {**options, "path": recorded[0]})
        assert page(lo, hi, limit, options).column("at").to_pylist() == want.column("at").to_pylist()
