import json
import os

import pytest

from conftest import rows_of
from cuelake import cli, settings, udtf
from cuelake.operators import chapters, completion


def transcript(n):
    return {"language": "en", "segments": [{"start": 4.0 * i, "end": 4.0 * i + 3, "text": f"Sentence number {i} of {n} is about copper pipes.", "words": []} for i in range(30)]}


def test_command_line(tmp_path, spark):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in ("a", "b"):
        (src / f"{n}.transcript.json").write_text(json.dumps(transcript(n)))
    assert cli.main(["all", str(src), "--out", str(out), "--diarize"]) == cli.OK
    assert sorted(os.listdir(out)) == ["a", "b"]
    assert sorted(os.listdir(out / "a")) == ["captions.srt", "captions.vtt", "chapters.md", "manifest.json", "summary.md", "transcript.txt"]
    first = (out / "a" / "captions.srt").read_text()
    assert cli.main(["all", str(src), "--out", str(out), "--skip-existing"]) == cli.OK
    assert (out / "a" / "captions.srt").read_text() == first
    (src / "c.transcript.json").write_text("{}")
    assert cli.main(["subs", str(src), "--out", str(out)]) == cli.PARTIAL
    assert cli.main(["subs", str(src / "c.transcript.json"), "--out", str(out)]) == cli.BAD_INPUT
    assert cli.main(["subs", str(tmp_path / "none.json"), "--out", str(out)]) == cli.NOT_FOUND
    assert cli.main(["fly"]) == cli.USAGE


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / ".env"
    f.write_text("# no\nCUELAKE_A = 'x'\nCUELAKE_B=2\nbroken\n=y\n")
    monkeypatch.setenv("CUELAKE_B", "1")
    assert settings.load_env(str(f)) == {"CUELAKE_A": "x"} and os.environ["CUELAKE_B"] == "1"
    assert settings.load_env(str(tmp_path / "none")) == {}
    assert settings.env_number("CUELAKE_B", 5.0) == 1.0 and settings.env_number("CUELAKE_A", 5.0) == 5.0
    monkeypatch.delenv("CUELAKE_A")


def test_table_functions(spark):
    udtf.register(spark)
    assert rows_of(spark.sql("SELECT s.* FROM VALUES ('One. Two!') AS t(x), LATERAL transcript_sentences(t.x) s")) == [(0, "One."), (1, "Two!")]
    assert spark.sql("SELECT c.* FROM VALUES ('word') AS t(x), LATERAL transcript_cues(t.x, 1.0D, 2.0D) c").first().lines == ["word"]


def test_retry_after():
    assert completion.retry_after("12") == 12.0 and completion.retry_after("-3") == 0.0
    assert completion.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", now=1445412470.0) == 10.0
    assert completion.retry_after("soon") is None and completion.retry_after(None) is None


def test_chapter_lines_and_fill(spark):
    df = spark.createDataFrame([(1, "- [01:00] - B\n00:00 A\nnothing\n1:00:05 C")], "media_id long, text string")
    assert rows_of(chapters.listed_chapters(df, "media_id")) == [(1, 0, 60.0, "B"), (1, 1, 0.0, "A"), (1, 3, 3605.0, "C")]
    kind = "media_id long, last double, times array<struct<i:int,start_s:double,sim:double>>, found array<struct<strength:double,start_s:double>>"
    for last, want in ((300.0, [0.0, 100.0, 200.0]), (100.0, [0.0])):
        times = spark.createDataFrame([(1, last, [(i, 10.0 * i, 0.1 if i == 10 else 0.5) for i in range(30)], None)], kind)
        made = spark.createDataFrame([(1, 0.0, "A")], "media_id long, start_s double, title string")
        assert chapters.filled_starts(made, times).first().starts == want
        nothing = spark.createDataFrame([], "media_id long, chapter_no int, words array<string>")
        assert [t for *_, t, _ in rows_of(chapters.titled(chapters.filled_starts(made, times), nothing, "Part", made))][1:] == [f"Part {k + 1}" for k in range(1, len(want))]


HEARS = """
def hears(path, start, end, language):
    from cuelake.errors import UndecodableMedia

    if "broken" in path:
        raise UndecodableMedia("no audio stream")
    return "en", [(0.0, 2.0, "We need to buy copper pipes.", [(0.0, 1.0, " We need"), (1.0, 2.0, " to buy copper pipes.")])]
"""


def test_command_line_over_media_and_texts(tmp_path, spark, monkeypatch):
    (tmp_path / "hearing_stand_in.py").write_text(HEARS)
    monkeypatch.syspath_prepend(str(tmp_path))
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in ("a.mp3", "a.wav", "broken.mp4"):
        (src / n).write_bytes(b"x")
    assert cli.main(["all", str(src), "--out", str(out), "--recogniser", "hearing_stand_in:hears", "--local"]) == cli.PARTIAL
    assert sorted(os.listdir(out)) == ["a", "a-wav"]
    made = json.loads((out / "a" / "transcript.json").read_text())
    assert made["text"] == "We need to buy copper pipes." and made["segments"][0]["words"][1]["word"] == " to buy copper pipes."
    mark = json.loads((out / "a" / "manifest.json").read_text())
    assert mark["finished_at"].endswith("Z") and mark["options"]["verb"] == "all" and mark["captions"].startswith("1 cues")
    assert cli.main(["transcribe", str(src / "broken.mp4"), "--out", str(out), "--recogniser", "hearing_stand_in:hears"]) == cli.UNDECODABLE
    assert cli.main(["transcribe", str(src / "a.mp3"), "--out", str(out)]) == cli.NO_MODEL
    (tmp_path / "note.txt").write_text("We need to buy copper. It rains. The river is wide today.")
    assert cli.main(["summarize", str(tmp_path / "note.txt"), "--out", str(out)]) == cli.OK
    assert "- [ ] We need to buy copper." in (out / "note" / "summary.md").read_text()
    assert cli.main(["all", str(tmp_path / "note.txt"), "--out", str(out)]) == cli.USAGE
    assert cli.main(["subs", str(src / "a.mp3"), "--out", str(out), "--recogniser", "hearing_stand_in:hears", "--translate", "es"]) == cli.USAGE
    assert cli.main(["subs", "x", "--chunk-length", "5", "--chunk-overlap", "5"]) == cli.USAGE


def test_breaker_and_gate():
    calls = []

    def fatal(messages):
        calls.append(1)
        raise completion.ServiceError("no key", 401, fatal=True)

    b = completion.Breaker(fatal, "test")
    for _ in range(3):
        with pytest.raises(completion.ServiceError):
            b([])
    assert len(calls) == 1
    assert completion.gated(False) == (None, None)
    assert completion.gated(True)[0] is None  # no key
    assert "switched off" in completion.gated(True, lambda: fatal)[1]
    flaky, warning = completion.gated(True, lambda: lambda m: "OK")
    assert warning is None and flaky([]) == "OK"


def test_chat_client_over_a_socket():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body["model"]))
            code, reply = (503, b"busy") if len(seen) == 1 else (200, json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode())
            self.send_response(code)
            self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = completion.ChatClient("k", f"http://127.0.0.1:{server.server_port}", "m")
    assert client([{"role": "user", "content": "x"}]) == "hi" and seen == [("Bearer k", "m")] * 2
    server.shutdown()


def test_media_tools_fail_with_their_kind(tmp_path):
    from types import SimpleNamespace

    from cuelake import errors
    from cuelake.operators import recognition

    assert recognition.probe_duration(str(tmp_path / "none.mp3")) is None
    assert recognition.probe_duration("x", lambda *a, **k: SimpleNamespace(stdout="12.5\n")) == 12.5
    with pytest.raises(errors.ToolNotFound):
        recognition.ensure_tool("no-such-tool")

    def broken():
        raise ImportError("no such model")

    with pytest.raises(errors.RecogniserUnavailable):
        recognition.once_for_each_worker("broken", broken)("p", 0, 1, None)


def test_chunks_that_fail_leave_the_others(spark):
    from cuelake.operators import recognition

    def hear(path, start, end, language):
        if path == "bad" and start > 20:
            raise OSError("cut off")
        return "en", [(2.0, end - start, f"from {start:g}", [])]

    media = spark.createDataFrame([(1, "good", None), (2, "bad", 60.0)], "media_id long, path string, duration double")
    seg, rows = recognition.transcribe(media, hear, probe=lambda p: 70.0)
    got = {r.media_id: r for r in rows.collect()}
    assert got[1].duration == 70.0 and got[1].error is None and got[1].text == "from 0 from 28 from 56"
    assert got[2].error == "OSError: cut off" and got[2].text == "from 0"
    assert [r.seg_ix for r in seg.where("media_id = 1").orderBy("start_s").collect()] == [0, 1, 2]
