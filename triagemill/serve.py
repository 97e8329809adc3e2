"""The report over HTTP, with feedback: each request is one commit to the store; rebuilds of the report wait for each other."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from triagemill import commands
from triagemill.operators import state
from triagemill.operators import triage as T
from triagemill.profile import add_skill, block_skill, remove_skill, skill_key
from triagemill.store import Conflict, Store

#: Attempts of a rebuild and seconds between them.
ATTEMPTS, PAUSE = 3, 0.2
#: Ports tried from the one asked on.
PORTS = 20


class Rebuilder:
    """Runs a job again whenever it is asked: asked many times during a run, it runs once more after it."""

    def __init__(self, job: Callable[[], object], attempts: int = ATTEMPTS, pause: float = PAUSE):
        self.job, self.attempts, self.pause = job, attempts, pause
        self.lock, self.running, self.asked, self.runs, self.error = threading.Lock(), False, False, 0, None

    def ask(self) -> None:
        with self.lock:
            self.asked = True
            if self.running:
                return
            self.running = True
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while True:
            with self.lock:
                if not self.asked:
                    self.running = False
                    return
                self.asked = False
            for _ in range(self.attempts):
                try:
                    self.job()
                    self.error = None
                    break
                except Exception as error:  # noqa: BLE001 - tried again, and kept for who asks
                    self.error = error
                    time.sleep(self.pause)
            self.runs += 1


class App:
    """What the requests do, apart from HTTP: a method and a path in, a status and an answer out."""

    def __init__(self, store: Store, profile_path: str, folder: str):
        self.store, self.profile_path, self.folder = store, profile_path, folder
        self.write = threading.Lock()
        self.rebuild = Rebuilder(lambda: commands.write_report(store, self.profile(), folder))
        self.posts = {
            "/api/feedback": self.feedback, "/api/viewed": self.viewed, "/api/applied": self.applied, "/api/applied/raw-text": self.raw_text, "/api/skill/user": self.user, "/api/skill/learn": self.learn, "/api/skill/block": self.block,
            "/api/skill/delete": self.delete,
        }

    def profile(self):
        return commands.load_profile(self.profile_path)

    def get(self, target: str) -> tuple[int, str]:
        parsed = urlparse(target)
        if parsed.path.rstrip("/") == "/company.html":
            company = parse_qs(parsed.query).get("company", [""])[0].strip()
            return (200, commands.company_page(self.store, company)) if company else (400, "<p>Which company? Add its name to the address.</p>")
        page = Path(self.folder) / "report.html"
        if parsed.path.rstrip("/") in ("", "/report.html"):
            if not page.is_file():
                commands.write_report(self.store, self.profile(), self.folder)
            return 200, page.read_text(encoding="utf-8")
        return 404, "<p>Not found.</p>"

    def post(self, path: str, body: dict) -> tuple[int, dict]:
        handler = self.posts.get(path.rstrip("/"))
        if handler is None:
            return 404, {"ok": False, "error": "Not found"}
        try:
            with self.write:
                answer = handler(body)
        except (ValueError, TypeError) as error:
            return 400, {"ok": False, "error": str(error)}
        except LookupError as error:
            return 404, {"ok": False, "error": str(error.args[0])}
        except Conflict as error:
            return 409, {"ok": False, "error": str(error)}
        self.rebuild.ask()
        return 200, {"ok": True, **answer}

    def _log(self, body: dict, event: str) -> dict:
        number, base, jobs = int(body["job_id"]) if "job_id" in body else _wrong("job_id is required"), self.store.version(), self.store.read("jobs")
        if jobs.where(F.col("id") == number).isEmpty():
            raise LookupError("no posting with this number")
        log = self.store.spark.createDataFrame([(number, 1, 1, event)], "job_id long, ts long, event_id long, event string")
        self.store.commit({"jobs": state.set_feedback(jobs, log, F.current_timestamp())}, base)
        return {"job_id": number}

    def _learn(self) -> None:
        commands.save_profile(self.profile_path, state.learned_profile(self.profile(), self.store.read("jobs")))

    def feedback(self, body: dict) -> dict:
        signal = str(body.get("signal", "")).strip().lower()
        if signal not in ("relevant", "not relevant"):
            raise ValueError("only 'relevant' and 'not relevant' can be told about a posting")
        out = self._log(body, signal.replace(" ", "_"))
        self._learn()
        return out | {"signal": signal}

    def viewed(self, body: dict) -> dict:
        return self._log(body, "viewed_on" if _flag(body, "viewed") else "viewed_off")

    def applied(self, body: dict) -> dict:
        out = self._log(body, "applied_on" if _flag(body, "applied") else "applied_off")
        if body["applied"]:
            self._learn()
        return out

    def raw_text(self, body: dict) -> dict:
        number, text = int(body.get("job_id") or _wrong("job_id is required")), str(body.get("text") or "").strip() or _wrong("text is required")
        base, jobs, now = self.store.version(), self.store.read("jobs"), F.current_timestamp()
        own = F.col("id") == number
        if jobs.where(own & (F.col("applied") == 1)).isEmpty():
            raise LookupError("no posting with this number that was applied for")
        jobs = state.append_text(jobs, self.store.spark.createDataFrame([(number, text)], "id long, text string"), now)
        jobs = commands.describe(jobs, now, candidates=jobs.where(own))
        profile = self.profile()
        patterns = state.pattern_table(self.store.read("skill_patterns"), profile)
        self.store.commit({"jobs": T.rescore(jobs, profile, own, patterns), "job_skills": state.clear_job(self.store.read("job_skills"), number)}, base)
        self._learn()
        return {"job_id": number, "manual_text_added": True}

    def _skill(self, body: dict) -> str:
        return skill_key(str(body.get("skill", ""))) or _wrong("skill is required")

    def _toggle(self, body: dict, flag: str, field: str) -> dict:
        skill, wanted, before = self._skill(body), _flag(body, flag), self.profile()
        left = tuple(x for x in getattr(before, field) if skill_key(x) != skill)
        after = add_skill(before, skill, field) if wanted else replace(before, **{field: left})
        commands.save_profile(self.profile_path, after)
        return {"skill": skill, flag: wanted, "changed": after != before}

    def user(self, body: dict) -> dict:
        return self._toggle(body, "has_skill", "user_skills")

    def learn(self, body: dict) -> dict:
        return self._toggle(body, "learn", "missing_skills_suggestions")

    def block(self, body: dict) -> dict:
        skill = self._skill(body)
        commands.save_profile(self.profile_path, block_skill(self.profile(), skill))
        return self._forget(skill)

    def delete(self, body: dict) -> dict:
        skill = self._skill(body)
        commands.save_profile(self.profile_path, remove_skill(self.profile(), skill))
        return self._forget(skill)

    def _forget(self, skill: str) -> dict:
        base, patterns, links = self.store.version(), self.store.read("skill_patterns"), self.store.read("job_skills")
        left, kept = state.delete_skill(patterns, links, skill)
        gone = {"skill": skill, "deleted_patterns": patterns.count() - left.count(), "deleted_links": links.count() - kept.count()}
        self.store.commit({"skill_patterns": left, "job_skills": kept}, base)
        return gone


def _wrong(message: str):
    raise ValueError(message)


def _flag(body: dict, name: str) -> bool:
    return body[name] if isinstance(body.get(name), bool) else _wrong(f"{name} takes true or false")


def server(app: App, host: str, port: int) -> ThreadingHTTPServer:
    """Bound to the port, or to the next one that is free."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            raw = body.encode()
            self.send_response(status)
            for name, value in (("Content-Type", kind), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._send(*(lambda status, body: (status, "text/html; charset=utf-8", body))(*app.get(self.path)))

        def do_OPTIONS(self) -> None:
            self._send(204, "text/plain", "")

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                body = None
            status, answer = app.post(self.path, body) if isinstance(body, dict) else (400, {"ok": False, "error": "send an object as JSON"})
            self._send(status, "application/json", json.dumps(answer))

        def log_message(self, *args) -> None:
            pass

    for n in range(PORTS):
        try:
            return ThreadingHTTPServer((host, port + n if port else 0), Handler)
        except OSError:
            if n == PORTS - 1:
                raise
    raise OSError("no port is free")


def serve(store: Store, profile_path: str, folder: str, host: str, port: int) -> None:
    app = App(store, profile_path, folder)
    commands.write_report(store, app.profile(), folder)
    with server(app, host, port) as http:
        print(f"http://{host}:{http.server_address[1]}/report.html")
        http.serve_forever()
