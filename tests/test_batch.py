"""The batch job with a service, salvage of long responses, and ingest from files with strange lines."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from inventra.config import INVENTORY_COLUMNS
from inventra.operators import batch, durable, sinks, verdicts
from inventra.sources import inventory


@pytest.fixture
def service():
    """A classifier that fails once and then answers; seen: bodies and their types."""
    seen, broken = [], [True]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if broken:
                broken.pop()
                self.send_error(500)
                return
            seen.append((self.headers["Content-Type"], body))
            self.reply({"task_id": f"t{len(seen)}"})

        def do_GET(self):
            self.reply({"status": "completed", "result": '{"security": {"classification": "C2", "confidence": 70}}'})

        def reply(self, found):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_service(service):
    base, seen = service
    ask = batch.http_classifier(base, "token", wait=0.01, poll=0.01)
    assert ask(["one"]) == ['{"security": {"classification": "C2", "confidence": 70}}']
    assert ask(["two"], [("a.txt", b"body")])[0].startswith('{"security"')
    assert json.loads(seen[0][1]) == {"prompt": "one"}
    kind, body = seen[1]
    assert kind.startswith("multipart/form-data; boundary=") and b"\r\n\r\ntwo\r\n" in body and b'filename="a.txt"' in body and b"\r\n\r\nbody\r\n" in body
    down = batch.http_classifier("http://127.0.0.1:9", "token", attempts=2, wait=0.01, open_seconds=0.01)
    assert down(["x"]) == [""]


def test_salvage_any_length():
    verdict = '{"security": {"classification": "C1"}}'
    for pad in (10, 100_000):
        assert json.loads(verdicts.salvage("note {x} " + "p" * pad + verdict + "q" * pad)) == json.loads(verdict)
        assert verdicts.salvage("note {x} " + "p" * pad) is None
    for hostile in ('{"a": ', '{"a": [', "[", "{", '{"', '": [{', '{"a": [{}, '):
        began = time.monotonic()
        assert verdicts.salvage(hostile * (400_000 // len(hostile))) is None
        assert verdicts.salvage(hostile * (400_000 // len(hostile)) + verdict) in (None, json.dumps(json.loads(verdict)))
        assert time.monotonic() - began < 8
    assert verdicts.salvage('{"a": [' * 8000 + " " + verdict) == json.dumps(json.loads(verdict))
    deep = '{"finance": {"amounts": [{"value": "1", "context": "a } b"}]}}'
    assert json.loads(verdicts.salvage("so: " + deep)) == json.loads(deep)


def test_salvage_as_reading_at_each_brace():
    """The same as trying the JSON reader at every brace in turn."""
    rng, reader = random.Random(1), json.JSONDecoder()
    parts = ["{", "}", "[", "]", '"', ":", ",", '"security"', '"a"', "1", "-", "1e5", "true", "null", '{"security": {}}', '{"security": 1}', " ", "\\", '\\"', "\n", "é", "NaN", "{}", '"\\u00e9"', '"\\x"']

    def plain(text):
        text = text.strip()
        try:
            whole = json.loads(text)
        except ValueError:
            whole = None
        if len(text) < 10 or whole is not None:
            return json.dumps(whole) if len(text) >= 10 and verdicts.valid(whole) else None
        at = text.find("{")
        while at >= 0:
            try:
                found, end = reader.raw_decode(text, at)
            except ValueError:
                end = at + 1
            else:
                if verdicts.valid(found):
                    return json.dumps(found)
            at = text.find("{", end)
        return None

    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(3, 14)))
        assert verdicts.salvage(text) == plain(text), text


def _inventory(spark, n, path="/s/f{}.txt"):
    """Files of n/2 contents, two of each; a few without a hash."""
    rows = [(i, f"f{i // 2}.txt", path.format(i), ".txt", 1000 + i // 2, "o", None if i < 4 else f"h{i // 2}", None, None, None, None, "pending", None, 50) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, path string, extension string, file_size long, owner string, fast_hash string, file_attributes string, file_signature string, last_modified string, creation_time string, status string, exclusion_reason string, priority_score int")


def _no_cache(spark):
    return spark.createDataFrame([], "cache_key string, response_content string, created_at timestamp, hits_count int, ttl_expiry timestamp, file_size long")


def _noting(folder, broken=None, bad=None):
    """A classifier that notes each prompt in a file of its own, raises at a prompt while a file `broken` is there, and gives no verdict for some while `bad` is there."""
    import os
    import uuid

    def classify(texts):
        if os.path.exists(f"{folder}/{broken}") and any("Name: f20.txt" in t for t in texts):
            raise RuntimeError("service is gone")
        for t in texts:
            with open(f"{folder}/asked-{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        none = os.path.exists(f"{folder}/{bad}")
        return ["no verdict, sorry" if none and "f1" in t else x for t, x in zip(texts, batch.offline(texts), strict=True)]

    return classify


def _asked(folder):
    return [p.read_text() for p in folder.glob("asked-*")]


AS_OF = "2024-06-01 00:00:00"


def test_asked_once_and_resumed(spark, tmp_path):
    """Each content is asked once; a run that breaks keeps its answers, and going on asks only for the rest."""
    files, notes, folder = _inventory(spark, 100), tmp_path / "notes", f"file://{tmp_path}/run"
    notes.mkdir()
    (notes / "broken").touch()
    sending = batch.Sending(in_flight=2, bounds=durable.Bounds(rows=1, commit_rows=3))
    ask = _noting(str(notes), broken="broken")
    with pytest.raises(Exception, match="service is gone"):
        batch.run_pending(files, _no_cache(spark), AS_OF, folder, classifier=ask, sending=sending)
    kept = _asked(notes)
    assert 0 < len(kept) < 52 and durable.results(spark, folder, batch.ANSWERS).count() == len(kept)
    (notes / "broken").unlink()
    done = batch.resumed(files, _no_cache(spark), AS_OF, folder, classifier=ask, sending=sending)
    # 48 contents of two files and four files without a hash, two of each prompt
    assert len(_asked(notes)) == 52 and len(set(_asked(notes))) == 50
    assert done.files.groupBy("status").count().collect() == [("completed", 100)]
    assert done.responses.count() == 100 and done.cache.count() == 48
    again = batch.resumed(files, _no_cache(spark), AS_OF, folder, classifier=ask, sending=sending)
    assert again.responses.count() == 100 and len(_asked(notes)) == 52


def test_errors_again_in_place(spark, tmp_path):
    """Errors are asked again in the folder of their run, and the last answer counts."""
    files, notes, folder = _inventory(spark, 100), tmp_path / "notes", f"file://{tmp_path}/run"
    notes.mkdir()
    (notes / "bad").touch()
    ask = _noting(str(notes), bad="bad")
    first = batch.run_pending(files, _no_cache(spark), AS_OF, folder, classifier=ask)
    first.files.write.parquet(f"{tmp_path}/files1")
    after = spark.read.parquet(f"{tmp_path}/files1")
    wrong = after.where("status = 'error'").count()
    asked = len(_asked(notes))
    assert wrong and asked == 52
    (notes / "bad").unlink()
    second = batch.run_errors(after, first.cache, AS_OF, folder, classifier=ask)
    assert second.files.where("status = 'error'").count() == 0 and second.files.where("status = 'completed'").count() == 100
    assert second.responses.count() == wrong and second.outcomes.count() == wrong
    assert len(_asked(notes)) - asked == len({t for t in _asked(notes) if "f1" in t}) + 1  # f1 has two files without a hash


def test_stopped(spark, tmp_path):
    files, folder = _inventory(spark, 40), f"file://{tmp_path}/run"
    sending = batch.Sending(in_flight=1, bounds=durable.Bounds(rows=4))
    plain = batch.offline

    def stopping(texts):
        durable.stop(folder)
        return plain(texts)

    first = batch.run_pending(files, _no_cache(spark), AS_OF, folder, classifier=stopping, sending=sending)
    assert durable.results(spark, folder, batch.ANSWERS).count() == 4
    assert 4 <= first.files.where("status = 'completed'").count() <= 8 and first.files.where("status = 'pending'").count() >= 32
    rest = batch.resumed(files, _no_cache(spark), AS_OF, folder)
    assert rest.files.where("status = 'completed'").count() == 40
    assert durable.results(spark, folder, batch.ANSWERS).groupBy("content_key").count().where("count > 1").isEmpty()


def test_documents_from_the_job(spark, tmp_path, service):
    """The job sends each distinct document once, as a form, with the prompt; one that can't be read ends in an error."""
    base, seen = service
    for i in range(20):
        (tmp_path / f"f{i}.txt").write_bytes(f"content {i // 2}".encode())
    (tmp_path / "f19.txt").unlink()
    (tmp_path / "f18.txt").unlink()
    files = _inventory(spark, 20, f"{tmp_path}/f{{}}.txt")
    sending = batch.Sending(in_flight=2, documents=True, portion_bytes=25)
    ask = batch.http_classifier(base, "token", wait=0.01, poll=0.01, busy_seconds=0.01)
    done = batch.run_pending(files, _no_cache(spark), AS_OF, f"file://{tmp_path}/run", classifier=ask, sending=sending)
    got = {r["id"]: (r["status"], r["exclusion_reason"]) for r in done.files.collect()}
    assert {i for i, (s, _) in got.items() if s == "completed"} == set(range(18))
    assert all(got[i][0] == "error" and got[i][1].startswith("Document not sent: FileNotFoundError") for i in (18, 19))
    bodies = [body for kind, body in seen if kind.startswith("multipart/form-data")]
    assert len(bodies) == len(seen) == 11  # 4 files without a hash, 7 pairs
    for i in range(2, 9):
        assert sum(f"\r\n\r\ncontent {i}\r\n".encode() in b for b in bodies) == 1


def test_two_halves(spark, tmp_path, service):
    """Posting and collecting are two stages; neither posts nor collects a content twice."""
    base, seen = service
    files, folder = _inventory(spark, 20), f"file://{tmp_path}/run"
    ask = batch.http_classifier(base, "token", wait=0.01, poll=0.01)
    once = batch.contents(batch.sorted_out(files, _no_cache(spark), AS_OF)[2])
    assert batch.upload(once, folder, ask) == 12 and len(seen) == 12
    assert batch.upload(once, folder, ask) == 0 and len(seen) == 12
    assert batch.collect_answers(spark, folder, ask) == 12
    assert batch.collect_answers(spark, folder, ask) == 0
    done = batch.run_pending(files, _no_cache(spark), AS_OF, folder, classifier=_never)
    assert done.files.where("status = 'completed'").count() == 20


def _never(texts):
    raise AssertionError("everything has an answer")


def test_busy_goes_to_the_back():
    """What is turned away for now is tried again after the others, and not before its time."""
    from inventra.operators.transport import Busy, Service

    tried = []

    def call(i):
        tried.append(i)
        if i == 0 and tried.count(0) < 3:
            raise Busy("429")
        return str(i)

    assert Service("http://x", "t", busy_seconds=0.05).queued([lambda i=i: call(i) for i in range(4)]) == ["0", "1", "2", "3"]
    assert tried == [0, 1, 2, 3, 0, 0]
    assert Service("http://y", "t", attempts=2, busy_seconds=0.01).queued([lambda: (_ for _ in ()).throw(Busy("503"))]) == [""]


def test_strict_columns():
    """Columns 0 to 5, 12 and 15 to 18 are quoted."""
    assert [i for i in range(len(INVENTORY_COLUMNS)) if i not in inventory.QUOTED] == [6, 7, 8, 9, 10, 11, 13, 14]


def test_scan_fields_as_scan(spark):
    lines = ["a,b,c", '"a,1",b,"c""d"', 'a"b,c"d,e', '"open,b', "", "  ", ",,", '"",x,""', 'x,"y"z', '"a"b"c",d', '"q""",', "é,\"ü,ß\""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").repartition(2)
    got = {r[0]: r[1] for r in rows.select("i", inventory.scan_fields(rows.line)).collect()}
    assert got == {i: inventory.scan(x) for i, x in enumerate(lines)}


def test_ingest_order(spark, tmp_path):
    """Of rows of one path the first stays: in the order of files, then of lines."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(("b.csv", "a.csv")):
        rows = [[{"Name": "same.txt", "UNCDirectory": "/s", "FileSize": str(1000 * k + i)}.get(c, "x") for c in INVENTORY_COLUMNS] for i in range(1, 4)]
        (folder / name).write_text("\n".join([",".join(INVENTORY_COLUMNS), *map(",".join, rows)]))
    inventory.ingest(spark, str(folder), str(tmp_path / "out"))
    assert [r["file_size"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1001]
    assert [r["FileSize"] for r in inventory.head(spark, str(folder), 2).collect()] == ["1001", "1002"]


def test_maintenance(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/a", 5, "pending", "o"), (1, "/a", 5, "pending", "o"), (2, "/b", -1, "odd", "o")], "id long, path string, file_size long, status string, owner string")
    source, saved = str(tmp_path / "t"), str(tmp_path / "s")
    rows.write.parquet(source)
    assert sinks.backup(spark, source, saved) == 3
    sinks.reset(spark, source)
    assert spark.read.parquet(source).count() == 0 and spark.read.parquet(source).columns == rows.columns
    with pytest.raises(ValueError):
        sinks.restore(spark, source, saved)
    assert sinks.restore(spark, saved, source) == 3
    assert sorted(tuple(r)[:4] for r in sinks.repaired(spark.read.parquet(source)).collect()) == [(1, "/a", 5, "pending"), (2, "/b", 0, "pending")]
    made = json.loads(sinks.report({"all": rows.groupBy("status").count()}, {"years": 1}, ["less"], "2024-01-01"))
    assert made["timestamp"] == "2024-01-01" and made["recommendations"] == ["less"] and len(made["metrics"]["all"]) == 2
