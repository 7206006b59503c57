"""The log grammar, and spans against a walk over the lines with queues and maps."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from titerloom.operators import loggrammar as G
from titerloom.operators import runlog as R
from titerloom.operators.scan import Running, running

#: One line of each kind, as a run writes them.
LINES = {
    "taskSpanStart": 'Task span start task_type=assemble.text job_id=7 task_key=file:3 file_ids=[3, 4] filenames=["a.pdf", "b c.pdf"]',
    "taskSpanFinish": 'Task span finish task_type=assemble.text job_id=7 task_key=file:3 file_ids=[3] filenames=["a.pdf"] duration=1.25s outcome=resolved',
    "jobStart": "Extraction job start stage=text job_id=5 file_id=3 filename=a.pdf pages=1-2 dpi=144 attempts=1 queued_requests=4 active_requests=2",
    "jobRetrySplit": "Extraction job retry split stage=text job_id=5 file_id=3 filename=a.pdf pages=1-2 dpi=144 fallback_ranges=1-1, 2-2 duration=2.50s error=HTTP 413: too big",
    "jobFailed": "Extraction job failed stage=measurements job_id=5 file_id=3 filename=a.pdf pages=1-1 dpi=100 duration=2.50s error=",
    "rangeStart": "Structured medical range start path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144 page_count=2",
    "rangeSuccess": "Document text range success path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144 duration=12.34s",
    "rangeFailed": "Document text range failed path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144 after 0.5s",
    "batchStart": "PDF batch extract start kind=Document text path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144",
    "batchDone": "PDF batch extract done kind=Document text path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144 duration=3.00s",
    "batchFailed": "PDF batch extract failed kind=Structured medical path=/d/a.pdf filename=a.pdf pages=1-2 dpi=144 after 3.00s",
    "renderStart": "Rendering PDF pages path=/d/x/a.pdf pages=1-2 dpi=144",
    "renderDone": "Rendered PDF pages path=/d/x/a.pdf pages=1-2 dpi=144 image_count=2 duration=0.75s",
    "requestStart": "Copilot request starting request_name=medical_summary request_id=ab12 model=m-5 reasoning_effort=high timeout=900.0s attachments=2 prompt_chars=1000 context=a.pdf:p1-2:144dpi",
    "requestReady": "Copilot request ready request_name=medical_summary request_id=ab12 attempt=1/3 lane=summary lane_wait_ms=1.5 semaphore_wait_ms=2.0 client_wait_ms=3.0 session_create_ms=4.0 queued_requests=3 active_requests=6",
    "requestHeartbeat": "Copilot request still running request_name=medical_summary request_id=ab12 lane=summary attempt=1/3 elapsed=30.00s queued_requests=0 active_requests=1",
    "requestRetrying": "Copilot request retrying request_name=medical_summary request_id=ab12 attempt=1/3 model=m-5 reasoning_effort=None attachments=0 duration=5.00s delay=2s error=connection reset",
    "requestFinished": "Copilot request finished request_name=medical_summary request_id=ab12 model=m-5 reasoning_effort=low attachments=0 duration=9.99s response_chars=100 usage_cost=0.3300 input_tokens=1000 output_tokens=20 cache_read_tokens=5 context=none",
    "summaryStart": "Medical summary start filename=a.pdf raw_text=True",
    "summaryFinished": "Medical summary finished filename=a.pdf has_summary=True has_lab_date=False has_source=True duration=10.00s",
    "normalizeSourceStart": "Normalize source start source_present=True filename_present=False filename=None existing_canonical=3",
    "normalizeSourceFinished": "Normalize source finished filename=a.pdf normalized=True duration=1.00s",
    "normalizeMarkerStart": "Normalize marker names start new_names=5 existing_canonical=9 batch_size=100 concurrency=2",
    "normalizeMarkerBatchStart": "Normalize marker names batch start batch=1/2 batch_names=5 existing_canonical=9",
    "normalizeMarkerBatchFinished": "Normalize marker names batch finished batch=1/2 resolved=4 existing_canonical=9",
    "normalizeMarkerFinished": "Normalize marker names finished input_names=5 representative_names=4 resolved=4 duration=20.00s",
    "workerCrash": "Worker loop crashed worker=w3 task_types=text, summary",
}
OTHERS = {
    "requestStart": ["Copilot request starting request_name=x request_id=ab model=m reasoning_effort=high timeout=9s attachments=0 prompt_chars=1", "Copilot request starting request_name=x request_id=ab model=m configured_reasoning_effort=high timeout=9s attachments=0 prompt_chars=1 context=none"],
    "requestReady": ["Copilot request ready request_name=x request_id=ab attempt=1/3 lane=l lane_wait_ms=1 semaphore_wait_ms=2 client_wait_ms=3 session_create_ms=4 applied_reasoning_effort=None queued_requests=3 active_requests=6"],
    "requestFinished": [
        "Copilot request finished request_name=x request_id=ab model=m reasoning_effort=low attachments=0 duration=9s response_chars=1 usage_cost=0.33",
        "Copilot request finished request_name=x request_id=ab model=m reasoning_effort=low attachments=0 duration=9s response_chars=1 usage_cost=0.33 input_tokens=1 output_tokens=2 cache_read_tokens=5",
        "Copilot request finished request_name=x request_id=ab model=m configured_reasoning_effort=low applied_reasoning_effort=low attachments=0 duration=9s response_chars=1 usage_cost=0.33 input_tokens=1 output_tokens=2 cache_read_tokens=5 context=a.png:300dpi",
    ],
    "normalizeSourceStart": ["Normalize source start source_present=True filename_present=False existing_canonical=3"],
    "normalizeSourceFinished": ["Normalize source finished normalized=False duration=1.00s"],
}
NEITHER = ["", "Task span start", "Task span start task_type=a job_id=x task_key=k file_ids=[] filenames=[]", "Saved file a.pdf", LINES["rangeStart"] + " more", "x" + LINES["workerCrash"], LINES["batchStart"].replace("a.pdf", "a b.pdf")]


def parsed(spark, messages):
    rows = [("l", k, f"2024-01-01 00:00:{k % 60:02d} INFO app.x {m}") for k, m in enumerate(messages)]
    lines = spark.createDataFrame(rows, "log string, entry long, line string")
    return G.events(lines.withColumn("h", G.header(F.col("line"))).where("h is not null").select("log", "entry", "h.*"))


def test_every_kind_of_line(spark):
    messages = [*LINES.values(), *[m for ms in OTHERS.values() for m in ms], *NEITHER]
    got = {r["entry"]: r for r in parsed(spark, messages).collect()}
    kinds = [*LINES, *[e for e, ms in OTHERS.items() for _ in ms]]
    assert len(LINES) == 27 == len(G.FORMATS) and {k: r["event"] for k, r in got.items()} == dict(enumerate(kinds))
    of = {e: got[k] for k, e in enumerate(LINES)}
    t = of["taskSpanFinish"]
    assert (t["task_type"], t["job_id"], t["task_key"], t["file_ids"], t["filenames"], t["duration_ms"], t["outcome"]) == ("assemble.text", 7, "file:3", [3], ["a.pdf"], 1250.0, "resolved")
    assert of["taskSpanStart"]["filenames"] == ["a.pdf", "b c.pdf"]
    j = of["jobRetrySplit"]
    assert (j["fallback_ranges"], j["duration_ms"], j["error"], j["page_count"], j["dpi"]) == ("1-1, 2-2", 2500.0, "HTTP 413: too big", 2, 144)
    assert of["renderStart"]["filename"] == "a.pdf" and of["rangeStart"]["kind"] == "Structured medical" and of["rangeFailed"]["duration_ms"] == 500.0
    q = of["requestReady"]
    assert (q["attempt"], q["attempt_max"], q["lane"], q["lane_wait_ms"], q["queued"], q["active"]) == (1, 3, "summary", 1.5, 3, 6)
    f = of["requestFinished"]
    assert (f["input_tokens"], f["usage_cost"], f["context"], f["effort"]) == (1000, 0.33, None, "low") and of["requestStart"]["context"] == "a.pdf:p1-2:144dpi"
    assert of["normalizeSourceStart"]["filename"] is None and of["normalizeSourceStart"]["source_present"] is True and of["workerCrash"]["task_types"] == "text, summary"


def test_headers(spark):
    rows = [("2024-01-01 10:00:00 NOTICE a.b_c text here",), ("2024-01-01 10:00:00 INFO a.b ",), ("2024-13-01 10:00:00 INFO a x",), ("  at line 3",), ("2024-01-01T10:00:00 INFO a x",), ("2024-01-01 10:00:00,123 INFO a x",)]
    got = [r["h"] for r in spark.createDataFrame(rows, "line string").select(G.header(F.col("line")).alias("h")).collect()]
    assert (got[0]["level"], got[0]["logger"], got[0]["message"]) == ("NOTICE", "a.b_c", "text here") and got[1]["message"] == "" and got[2]["ts"] is None and got[3:] == [None] * 3


def test_running_equals_one_window(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 1, -2, 3])) for k in r.sample(range(400), 250)]
    frame = spark.createDataFrame(rows, "k string, at long, v long")
    got = running(frame, ["k"], "at", [Running("s", "sum", F.col("v")), Running("m", "low", F.coalesce("v", F.lit(0))), Running("l", "last", F.col("v")), Running("b", "sum", F.col("v"), True)], 17).collect()
    assert len(got) == 250
    for x in got:
        upto = [v for k, at, v in sorted(rows, key=lambda t: t[1]) if k == x["k"] and at <= x["at"]]
        before = [v for k, at, v in rows if k == x["k"] and at < x["at"]]
        sums = [sum(v or 0 for v in upto[: k + 1]) for k in range(len(upto))]
        known = [v for v in upto if v is not None]
        assert (x["s"], x["m"], x["l"], x["b"]) == (sums[-1], min(sums), known[-1] if known else None, sum(v or 0 for v in before))


def message(r, k):
    """A line whose keys are few, so that spans of a kind overlap in every way."""
    f, p, stage = r.choice("ab"), r.choice(["1-2", "3-3"]), r.randrange(2)
    kind = ("Document text", "Structured medical", "Other")[stage if r.random() < 0.9 else 2]
    own, took = f"filename={f}.pdf pages={p} dpi=144", f"duration={r.randrange(0, 9)}.5s"
    at = f"path=/d/{f}.pdf {own}"
    task = f'task_type={r.choice(["generate.summary", "canonize.x", "other.y"])} job_id={r.randrange(2)} task_key=k file_ids=[1] filenames=["{f}.pdf", " {f}.pdf", ""]'
    job = f"stage={('text', 'measurements')[stage]} job_id={r.randrange(400) if r.random() < 0.7 else 0} file_id=1 {own}"
    name = r.choice(["document_text_extraction", "structured_medical_extraction", "medical_summary", "normalize_source_name", "normalize_marker_names", "odd_name"])
    asked = f"request_name={name} request_id=r{r.randrange(6)}"
    context = r.choice(["", " context=none", " context=c.pdf:p1-2:144dpi", " context=c.png:300dpi", " context=odd"])
    return r.choice(
        [f"Task span start {task}", f"Task span finish {task} {took} outcome=x", f"Extraction job start {job} attempts=1 queued_requests={k % 7} active_requests={k % 5}"]
        + [f"Extraction job start {job} attempts=1 queued_requests=0 active_requests=0", f"Extraction job retry split {job} fallback_ranges=1-1 {took} error=e", f"Extraction job failed {job} {took} error=e"]
        + [f"{kind} range start {at} page_count=2", f"{kind} range success {at} {took}", f"{kind} range failed {at} after 1.5s", f"PDF batch extract start kind={kind} {at}", f"PDF batch extract start kind={kind} {at}", f"PDF batch extract done kind={kind} {at} {took}"]
        + [f"Rendering PDF pages path=/d/{f}.pdf pages={p} dpi=144", f"Rendered PDF pages path=/d/{f}.pdf pages={p} dpi=144 image_count=2 {took}"]
        + [f"Copilot request starting {asked} model=m reasoning_effort=e timeout=9s attachments=1 prompt_chars=1{context}"] * 3
        + [f"Copilot request ready {asked} attempt=1/3 lane=l{k % 3} lane_wait_ms=1.5 semaphore_wait_ms=2 client_wait_ms=0 session_create_ms=0 queued_requests=1 active_requests=1", f"Copilot request still running {asked} lane=h attempt=2/3 elapsed=4.5s queued_requests=1 active_requests=1"]
        + [f"Copilot request retrying {asked} attempt=1/3 model=n reasoning_effort=e attachments=1 {took} delay=1s error=e", f"Copilot request finished {asked} model=m reasoning_effort=e attachments=1 {took} response_chars=1 usage_cost=0.5 input_tokens={k} output_tokens=2 cache_read_tokens=3"]
        + [f"Medical summary start filename={f}.pdf raw_text=True", f"Medical summary finished filename={f}.pdf has_summary=True has_lab_date=True has_source=True {took}"]
        + [f"Normalize source start source_present=True filename_present=True filename={f}.pdf existing_canonical=1", f"Normalize source finished normalized=True {took}"]
        + ["Normalize marker names start new_names=1 existing_canonical=1 batch_size=1 concurrency=1", f"Normalize marker names finished input_names=1 representative_names=1 resolved=1 {took}"]
        + ["Normalize marker names batch start batch=1/1 batch_names=1 existing_canonical=1", "Normalize marker names batch finished batch=1/1 resolved=1 existing_canonical=1", "Worker loop crashed worker=w task_types=t", "noise"]
    )


class Walk:
    """Line after line; open spans in maps and queues."""

    def __init__(self):
        self.done, self.tasks, self.jobs, self.waiting, self.asked = [], {}, {}, {}, {}

    def span(self, e, type_, start=None, files=(), pages=None, **more):
        s = {"type": type_, "start": e["ts_ms"] if start is None else start, "place": e["entry"], "files": [*files], "pages": pages, "lane": None, "folded": False, "kids": [], "over": None, "claimed": False} | more
        return s

    def close(self, s, e, status, end=None):
        if s["over"] is None:
            ms = e["duration_ms"] or 0
            end = (max(e["ts_ms"], s["start"] + ms) if ms else e["ts_ms"]) if end is None else end
            s |= {"over": e["entry"], "status": status, "end": max(end, s["start"])}
            self.done.append(s)
        return s

    def put(self, key, s):
        self.waiting.setdefault(key, deque()).append(s)

    def take(self, key):
        return self.waiting[key].popleft() if self.waiting.get(key) else None

    def lone(self, e, type_, **more):
        return self.span(e, type_, e["ts_ms"] - (e["duration_ms"] or 0), **more)

    def newest(self, key):
        best = None
        for s in self.waiting.get((key,), ()):
            if best is None or s["start"] > best["start"]:
                best = s
        return best

    def feed(self, e):
        kind, name = e["event"], [e["filename"]] if e["filename"] else []
        pages = (e["start_page"], e["stop_page"], e["page_count"])
        queues = {"summary": "summary", "normalizeSource": "normalization", "normalizeMarkerBatch": "normalization", "normalizeMarker": "normalization"}
        if kind.startswith("task"):
            key = (e["task_type"], e["job_id"], e["task_key"])
            type_ = {"generate.summary": "summary", "canonize.x": "normalization"}.get(key[0], "job")
            files = list(dict.fromkeys(f.strip() for f in e["filenames"] if f.strip()))
            if kind.endswith("Start"):
                self.tasks[key] = self.span(e, type_, files=files)
            else:
                self.close(self.tasks.pop(key, None) or self.lone(e, type_, files=files), e, "success")
        elif kind == "jobStart":
            s = self.span(e, "job", files=name, pages=pages, id=e["job_id"], sig=("job", e["stage"], e["filename"], *pages[:2], e["dpi"]))
            self.jobs[e["job_id"]] = s
            self.put(s["sig"], s)
        elif kind in ("jobRetrySplit", "jobFailed"):
            s = self.jobs.pop(e["job_id"], None)
            if s:
                self.waiting[s["sig"]].remove(s)
            self.close(s or self.lone(e, "job", files=name, pages=pages), e, "split" if kind == "jobRetrySplit" else "error")
        elif kind.startswith(("range", "batch", "render")):
            type_ = "range" if kind[1] == "a" and kind[0] == "r" else "batch" if kind[0] == "b" else "render"
            key = (type_, e["kind"] if type_ != "render" else e["path"], e["filename"], *pages[:2], e["dpi"])
            if kind.endswith("Start"):
                self.put(key, self.span(e, type_, files=name, pages=pages, kind=e["kind"]))
                return
            status = "error" if kind.endswith("Failed") else "success"
            s = self.close(self.take(key) or self.lone(e, type_, files=name, pages=pages), e, status)
            stage = R.KIND_TO_STAGE.get(e["kind"])
            if type_ == "range" and stage and (j := self.take(("job", stage, e["filename"], *pages[:2], e["dpi"]))):
                if self.jobs.get(j["id"]) is j:
                    del self.jobs[j["id"]]
                self.close(j, e, status, s["end"])
        elif kind.startswith("request"):
            self.request(e, kind)
        elif kind == "workerCrash":
            self.close(self.span(e, "error"), e, "error")
        else:
            head = next(q for q in queues if kind.startswith(q))
            files = name if head in ("summary", "normalizeSource") else []
            if kind.endswith("Start"):
                s = self.span(e, queues[head], files=files)
                above = self.waiting.get(("normalizeMarker",))
                if head == "normalizeMarkerBatch" and above:
                    above[-1]["kids"].append(s)
                self.put((head,), s)
            else:
                s = self.close(self.take((head,)) or self.lone(e, queues[head], files=files), e, "success")
                if head == "normalizeMarker" and len(s["kids"]) == 1 and s["kids"][0]["over"] is not None:
                    s["kids"][0]["folded"] = True

    def request(self, e, kind):
        s = self.asked.get(e["request_id"])
        if kind == "requestStart":
            told, context = None, e["context"]
            if context and context.endswith("dpi"):
                told = (["c.pdf"], (1, 2, 2)) if ":p" in context else (["c.png"], (None, None, None))
            if told is None and (of := self.context(e["request_name"])):
                told = of["files"], of["pages"]
            files, pages = told or ([], None)
            self.asked[e["request_id"]] = self.span(e, "request", files=files, pages=pages, retries=0, beats=[], tokens=None, name=e["request_name"])
            return
        worked = e["duration_ms"] or 0
        if kind == "requestReady":
            worked = sum(e[f"{c}_ms"] for c in ("lane_wait", "semaphore_wait", "client_wait", "session_create"))
        if s is None:
            s = self.asked[e["request_id"]] = self.span(e, "request", e["ts_ms"] - worked, retries=0, beats=[], tokens=None, name=e["request_name"])
        if kind in ("requestReady", "requestHeartbeat"):
            s["lane"] = e["lane"]
        if kind == "requestHeartbeat":
            s["beats"].append(max(e["ts_ms"], s["start"] + worked))
        s["retries"] += kind == "requestRetrying"
        if kind == "requestFinished":
            s["tokens"] = e["input_tokens"]
            self.close(self.asked.pop(e["request_id"]), e, "success")

    def context(self, name):
        if name in R.BATCH_OF_REQUEST:
            free = [s for key, q in self.waiting.items() if key[0] == "batch" for s in q if s["kind"] == R.BATCH_OF_REQUEST[name] and not s["claimed"]]
            best = min(free, key=lambda s: s["place"], default=None)
            if best:
                best["claimed"] = True
            return best
        if name == "normalize_marker_names":
            return self.newest("normalizeMarkerBatch") or self.newest("normalizeMarker")
        return {"medical_summary": self.newest("summary"), "normalize_source_name": self.newest("normalizeSource")}.get(name)

    def finish(self, last):
        left = [*self.tasks.values(), *self.jobs.values(), *self.asked.values(), *[s for key, q in self.waiting.items() if key[0] != "job" for s in q]]
        for s in left:
            s |= {"status": "open", "end": max(last, s["start"])}
            self.done.append(s)
        return self.done


@pytest.mark.parametrize("seed", [1])
def test_spans_equal_a_walk(spark, seed):
    r = random.Random(seed)
    rows, ts = [], {"a": 0, "b": 0}
    for k in range(1500):
        log = r.choice("ab")
        ts[log] += r.choice([0, 0, 1, 7])
        rows.append((log, k, f"2024-01-01 {ts[log] // 3600:02d}:{ts[log] // 60 % 60:02d}:{ts[log] % 60:02d} INFO app.x {message(r, k)}"))
    lines = spark.createDataFrame(rows, "log string, entry long, line string")
    ev = G.events(lines.withColumn("h", G.header(F.col("line"))).select("log", "entry", "h.*")).cache()
    want = []
    for log in "ab":
        walk, mine = Walk(), sorted((e.asDict() for e in ev.where(F.col("log") == log).collect()), key=lambda e: e["entry"])
        for e in mine:
            walk.feed(e)
        for s in walk.finish(max(e["ts_ms"] for e in mine)):
            more = (s["lane"], s["retries"], tuple(s["beats"]), s["tokens"]) if s["type"] == "request" else (None, None, (), None)
            want.append((log, s["type"], s["place"], s["status"], s["start"], s["end"], -1 if s["over"] is None else s["over"], tuple(s["files"]), tuple(s["pages"] or (None,) * 3), s["folded"], *more))
    spans = R.spans(ev, size=97).cache()
    got = [(x["log"], x["type"], x["place"], x["status"], x["start_ms"], x["end_ms"], x["closed"] if x["closed"] is not None else -1, tuple(x["files"]), (x["page_start"], x["page_stop"], x["page_count"]), x["folded"], x["lane"], x["retries"], tuple(x["heartbeats"] or ()), x["input_tokens"]) for x in spans.collect()]
    key = lambda t: (t[0], t[2], t[1], t[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    differ = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    assert not differ, (len(differ), differ[:4])
    assert len(got) == len(want) and sum(x[9] for x in want) > 0
    total = {x["log"]: x for x in R.summary(spans, ev).collect()}
    for log in "ab":
        mine = [w for w in want if w[0] == log]
        assert (total[log]["spans"], total[log]["open"], total[log]["errors"], total[log]["requests"]) == (len(mine), sum(w[3] == "open" for w in mine), sum(w[3] == "error" for w in mine), sum(w[1] == "request" for w in mine))
        assert total[log]["files"] == len({f for w in mine for f in w[7]})
    ev.unpersist()
    spans.unpersist()
