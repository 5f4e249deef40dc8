"""The batch job: filter, score, cache, classify what is left, interpret, store.

The classifier is a function of prompts (and documents, if they are sent), called with some at a time; each distinct content is classified once, and its answer
is committed before anything reads it. A real service is `transport.Service`; queries use the offline one.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MB, Rules
from ..sources import shared
from . import answers, durable, paging, prompts, rules, sinks, transport, verdicts

#: From prompts (and, if documents are sent, as many names and contents) to answers.
Classifier = Callable[..., list[str]]


def offline(texts: list[str]) -> list[str]:
    """A deterministic verdict from the prompt's length."""
    return [json.dumps({"resume": "offline", "security": {"classification": f"C{len(t) % 4}", "confidence": 50 + len(t) % 50}, "rgpd": {"risk_level": "none", "confidence": 50}, "finance": {"document_type": "none", "confidence": 0}, "legal": {"contract_type": "none", "confidence": 0}}) for t in texts]


def by_document(texts: list[str], files: list[transport.File]) -> list[str]:
    """A deterministic verdict from the document's length in bytes."""
    return offline(["x" * (len(content) % 100) for _, content in files])


class OfflineService(transport.Service):
    """A service without a network: a prompt's task is its text."""

    def submit(self, prompt: str, file: transport.File | None = None) -> str:
        return prompt

    def result(self, task: str) -> str:
        return offline([task])[0]


def http_classifier(base: str, token: str, **settings: float) -> transport.Service:
    """A service as a classifier; the settings are those of transport.Service."""
    return transport.Service(base, token, **settings)


_DOMAINS = ("security", "rgpd", "finance", "legal")
_COLUMNS = {"security": "security_analysis", "rgpd": "rgpd_analysis", "finance": "finance_analysis", "legal": "legal_analysis"}


ANSWERS = "content_key string, content string, failed string"
_TASKS = "content_key string, task string, failed string"
#: Documents of more bytes aren't sent.
MOST_DOCUMENT = 100 * MB


@dataclasses.dataclass(frozen=True)
class Sending:
    """How contents are asked: tasks at a time in the whole cluster, portions and commits, and whether (and up to which size) the document itself is sent."""

    in_flight: int | None = None
    bounds: durable.Bounds = durable.Bounds()
    documents: bool = False
    most_document: int = MOST_DOCUMENT
    portion_bytes: int = 32 * MB


def _documents(rows: list[dict], sending: Sending) -> Iterator[tuple[list[int], list[transport.File], dict[int, str]]]:
    """Places of rows with their documents, in portions bounded in bytes, and why others couldn't be read."""
    places, files, failed, size = [], [], {}, 0
    for i, row in enumerate(rows):
        try:
            content = transport.read_document(row["path"], sending.most_document)
        except (OSError, ValueError) as e:
            failed[i] = f"Document not sent: {type(e).__name__}: {e}"[:500]
            continue
        if places and size + len(content) > sending.portion_bytes:
            yield places, files, {}
            places, files, size = [], [], 0
        places.append(i)
        files.append((row["path"].replace("\\", "/").rsplit("/", 1)[-1], content))
        size += len(content)
    yield places, files, failed


def _asking(classifier: Classifier, sending: Sending) -> durable.Step:
    """From rows of prompts (and paths) to answers."""

    def step(rows: list[dict]) -> list[dict]:
        if not sending.documents:
            return [{"content": c, "failed": None} for c in classifier([r["prompt"] for r in rows])]
        out: list[dict] = [{}] * len(rows)
        for places, files, failed in _documents(rows, sending):
            told = classifier([rows[i]["prompt"] for i in places], files) if places else []
            for i, content in zip(places, told, strict=True):
                out[i] = {"content": content, "failed": None}
            for i, why in failed.items():
                out[i] = {"content": None, "failed": why}
        return out

    return step


_KEPT = ["id", "fast_hash", "file_size", "prompt_hash", "priority_score"]


def sorted_out(files: DataFrame, cache: DataFrame, as_of: str, filters: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files that the rules leave out, those that the cache answers, and those to be asked, with prompt and content_key.

    Files of the same hash, size and prompt are one content; a file without a hash is its own content.
    """
    rows = files.withColumns({"reason": rules.exclusion_reason(filters), "priority_score": rules.priority_score(filters), "prompt": prompts.build()})
    rows = rows.withColumn("prompt_hash", F.md5("prompt"))
    none = F.lit(None).cast("string")
    left_out = rows.where("reason <> 'ok'").select(*_KEPT, F.lit("filtered").alias("outcome"), F.col("reason").alias("error"), none.alias("content"))
    probed = answers.probe(rows.where("reason = 'ok'"), cache, as_of)
    known = probed.where("hit <> 'miss'").select(*_KEPT, F.lit("cached").alias("outcome"), none.alias("error"), F.col("answer").alias("content"))
    content_key = F.concat_ws("_", F.coalesce("fast_hash", F.concat(F.lit("id"), F.col("id").cast("string"))), F.col("file_size").cast("string"), "prompt_hash")
    return left_out, known, probed.where("hit = 'miss'").select(*_KEPT, "prompt", "path", content_key.alias("content_key"))


def contents(missing: DataFrame) -> DataFrame:
    """A row each distinct content: content_key, prompt, path (of one of its files) and the highest score."""
    return missing.groupBy("content_key").agg(F.min("prompt").alias("prompt"), F.min("path").alias("path"), F.max("priority_score").alias("priority_score"))


def ask(once: DataFrame, folder: str, classifier: Classifier = offline, attempt: int = 0, again: bool = False, sending: Sending = Sending()) -> int:
    """Asks for contents that have no answer in the folder yet (again: none of this attempt), each once, and commits answers as they come; how many."""
    found = durable.results(once.sparkSession, folder, ANSWERS)
    todo = durable.remaining(once, found, "content_key", attempt if again else None)
    return durable.run(todo, folder, "content_key", _asking(classifier, sending), ANSWERS, attempt, sending.in_flight, sending.bounds)


def told(spark: SparkSession, folder: str) -> DataFrame:
    """content_key, outcome, error and content of each content's last answer."""
    last = durable.latest(durable.results(spark, folder, ANSWERS), "content_key").withColumn("status", F.lit("completed"))
    read = verdicts.interpret(last)
    failed = F.col("failed").isNotNull()
    return read.select("content_key", F.when(failed, "error").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("failed", "error").alias("error"), "content")


def outcomes(files: DataFrame, cache: DataFrame, as_of: str, classifier: Classifier | None = offline, filters: Rules = Rules(), folder: str | None = None, attempt: int = 0, again: bool = False, sending: Sending = Sending()) -> DataFrame:
    """Each file with outcome (filtered, cached, completed, error), error, priority_score, content (the answer) and what was asked.

    Answers are committed to the folder (one that the cluster shares; without one, a new one) while they come. Files of a content without one (the run was stopped) have no row. Without a classifier,
    only the answers that the folder holds are used.
    """
    folder = folder or shared.folder(files.sparkSession, "answers")
    left_out, known, missing = sorted_out(files, cache, as_of, filters)
    if classifier is not None:
        ask(contents(missing), folder, classifier, attempt, again, sending)
    asked = missing.join(told(files.sparkSession, folder), "content_key").select(*_KEPT, "outcome", "error", "content")
    return left_out.unionByName(known).unionByName(asked)


def classify_files(files: DataFrame, cache: DataFrame, as_of: str, classifier: Classifier = offline, filters: Rules = Rules(), folder: str | None = None) -> DataFrame:
    """id, outcome, error, priority_score, classification of each file."""
    done = verdicts.with_json(outcomes(files, cache, as_of, classifier, filters, folder), F.when(F.col("outcome").isin("completed", "cached"), F.col("content")), "json")
    return done.select("id", "outcome", "error", "priority_score", F.get_json_object("json", "$.security.classification").alias("classification"))


def upload(once: DataFrame, folder: str, service: transport.Service, sending: Sending = Sending()) -> int:
    """The first half of asking: posts each content that has no task yet and commits the tasks' names; how many."""

    def step(rows: list[dict]) -> list[dict]:
        out: list[dict] = [{"task": None, "failed": "Not taken"} for _ in rows]
        portions = _documents(rows, sending) if sending.documents else [(list(range(len(rows))), None, {})]
        for places, files, failed in portions:
            names = service.queued([lambda i=i, k=k: service.submit(rows[i]["prompt"], files[k] if files else None) for k, i in enumerate(places)])
            for i, name in zip(places, names, strict=True):
                if name:
                    out[i] = {"task": name, "failed": None}
            for i, why in failed.items():
                out[i] = {"task": None, "failed": why}
        return out

    place = f"{folder}/uploads"
    todo = durable.remaining(once, durable.results(once.sparkSession, place, _TASKS), "content_key")
    return durable.run(todo, place, "content_key", step, _TASKS, 0, sending.in_flight, sending.bounds)


def collect_answers(spark: SparkSession, folder: str, service: transport.Service, attempt: int = 0, sending: Sending = Sending()) -> int:
    """The second half: asks for the results of posted contents that have no answer yet and commits them where `told` reads; how many."""
    posted = durable.latest(durable.results(spark, f"{folder}/uploads", _TASKS), "content_key").drop("attempt")

    def step(rows: list[dict]) -> list[dict]:
        found = iter(service.queued([lambda t=r["task"]: service.result(t) for r in rows if r["task"]]))
        return [{"content": next(found), "failed": None} if r["task"] else {"content": None, "failed": r["failed"]} for r in rows]

    todo = durable.remaining(posted, durable.results(spark, folder, ANSWERS), "content_key")
    return durable.run(todo, folder, "content_key", step, ANSWERS, attempt, sending.in_flight, sending.bounds)


@dataclasses.dataclass(frozen=True)
class Batch:
    """The tables after a run: all files, the responses that it adds, all of the cache; and each processed file's outcome."""

    files: DataFrame
    responses: DataFrame
    cache: DataFrame
    outcomes: DataFrame


def _begun(folder: str) -> list[tuple[int, str]]:
    """Attempts in a folder and what they were about, the last one last."""
    from pyarrow import fs

    system, path = shared.open_fs(f"{folder}/runs")
    system.create_dir(path, recursive=True)
    names = (f.base_name for f in system.get_file_info(fs.FileSelector(path)))
    return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names)


def _begin(folder: str, kind: str) -> int:
    """The number of a new attempt, noted in the folder; a wish to stop an earlier one is over."""
    durable.go_on(folder)
    number = max((n for n, _ in _begun(folder)), default=-1) + 1
    system, path = shared.open_fs(f"{folder}/runs/{number}-{kind}")
    with system.open_output_stream(path):
        pass
    return number


_PENDING, _ERROR = "pending", "error"


def run(files: DataFrame, cache: DataFrame, as_of: str, work: DataFrame, folder: str, classifier: Classifier = offline, filters: Rules = Rules(), ttl_hours: int = 168, kind: str = _PENDING, attempt: int | None = None, sending: Sending = Sending()) -> Batch:
    """Classifies the work and applies the outcomes to files, responses and cache.

    The folder (one that the cluster shares) holds answers as they come, so a run that breaks off has kept them, and goes on with `resumed`: no content
    is asked twice in an attempt, and a new attempt over pending files asks only for contents without any answer. One over errors asks for all of its contents again; a content's
    last answer counts.
    """
    spark = files.sparkSession
    attempt = _begin(folder, kind) if attempt is None else attempt
    place = f"{folder}/outcomes/attempt={attempt}"
    outcomes(work, cache, as_of, classifier, filters, folder, attempt, kind == _ERROR, sending).write.mode("overwrite").parquet(place)
    return applied(files, cache, as_of, spark.read.parquet(place), ttl_hours)


def applied(files: DataFrame, cache: DataFrame, as_of: str, done: DataFrame, ttl_hours: int = 168) -> Batch:
    """The tables after outcomes: statuses, a response for each completed or cached file, an answer in the cache for each completed content."""
    reason = F.when(F.col("outcome").isin("error", "filtered"), F.col("error"))
    after = sinks.with_status(files, done.select("id", F.col("outcome").alias("status"), reason.alias("exclusion_reason"), F.lit(0).alias("seq")))
    good = done.where(F.col("outcome").isin("completed", "cached"))
    read = verdicts.interpret(good.select("id", "content", F.lit("completed").alias("status")))
    rows = read.select(F.col("id").alias("fichier_id"), *[F.to_json(f"verdict.{k}").alias(_COLUMNS[k]) for k in _DOMAINS], *[f"{k}_confidence" for k in _DOMAINS], "confidence_global", "resume", F.col("content").alias("raw_response"))
    moment = F.to_timestamp(F.lit(as_of))
    new = done.where((F.col("outcome") == "completed") & F.col("fast_hash").isNotNull()).select(
        answers.key(F.col("fast_hash"), F.coalesce("file_size", F.lit(0)), F.col("prompt_hash")).alias("cache_key"), F.col("content").alias("response_content"), moment.alias("created_at"), (moment + F.expr(f"make_dt_interval(0, {ttl_hours})")).alias("ttl_expiry"), F.coalesce("file_size", F.lit(0)).alias("file_size"),
    )
    return Batch(after, verdicts.stored(rows), answers.put(cache, new.dropDuplicates(["cache_key"])), done)


def run_pending(files: DataFrame, cache: DataFrame, as_of: str, folder: str, limit: int | None = None, classifier: Classifier = offline, filters: Rules = Rules(), sending: Sending = Sending()) -> Batch:
    """The pending files; with a limit, those of the highest scores."""
    work = files.where("status = 'pending'") if limit is None else paging.pending(files, limit)
    return run(files, cache, as_of, work, folder, classifier, filters, sending=sending)


def run_errors(files: DataFrame, cache: DataFrame, as_of: str, folder: str, classifier: Classifier = offline, filters: Rules = Rules(), sending: Sending = Sending()) -> Batch:
    """Once more, the files that ended in an error; also in the folder of the run in which they did."""
    return run(files, cache, as_of, files.where("status = 'error'"), folder, classifier, filters, kind=_ERROR, sending=sending)


def resumed(files: DataFrame, cache: DataFrame, as_of: str, folder: str, classifier: Classifier = offline, filters: Rules = Rules(), sending: Sending = Sending()) -> Batch:
    """Goes on with the last attempt in the folder (a first one, if there is none): contents that it has no answer for are asked, then all outcomes are applied."""
    begun = _begun(folder)
    attempt, kind = begun[-1] if begun else (None, _PENDING)
    durable.go_on(folder)
    return run(files, cache, as_of, files.where(F.col("status") == kind), folder, classifier, filters, kind=kind, attempt=attempt, sending=sending)
