"""A web page for the reader, by the standard library: upload a paper for a guided reading, or ask the corpus.

    python -c "from lectern.plans.web import serve; serve(reader, 8501)"

One request is answered at a time: each is a Spark job. It is for a trusted network; there are no accounts.
"""

from __future__ import annotations

import html
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

from lectern.operators import providers
from lectern.operators.pdf import PdfText
from lectern.plans.reader import Reader

PAGE = """<!doctype html><meta charset="utf-8"><title>Lectern</title>
<h1>Papers</h1>
<form method="post" action="/ask"><input name="question" size="80" placeholder="Ask the corpus"><input name="k" value="5" size="2"><button>Ask</button></form>
<form id="read"><input type="file" id="file"><button>Read a paper</button></form>
<script>document.getElementById("read").onsubmit = async e => {{ e.preventDefault();
  const r = await fetch("/read", {{method: "POST", body: document.getElementById("file").files[0]}}); document.open(); document.write(await r.text()); document.close(); }}</script>
{body}"""


def section(title: str, text: str | None) -> str:
    return f"<h2>{html.escape(title)}</h2><p>{html.escape(text or '')}</p>"


def answered(reader: Reader, question: str, k: int) -> str:
    asked = reader.spark.createDataFrame([(0, question)], "item_id long, text string")
    row = reader.answer(asked, k).first()
    sources = "".join(f"<li>chunk {x.doc_id}, score {x.score:.3f}</li>" for x in row.sources)
    return section(question, row.answer) + f"<ol>{sources}</ol>"


def guided(reader: Reader, content: bytes) -> str:
    """A guided reading of an uploaded paper, which is kept nowhere."""
    uploaded = reader.spark.createDataFrame([(0, bytearray(content))], "doc_id long, content binary")
    paper = providers.parse_pdfs(uploaded, PdfText()).first()
    if paper.error:
        return section("This paper cannot be read", paper.error)
    guide = reader.read_paper(reader.spark.createDataFrame([(0, paper.text)], "doc_id long, text string")).first().guide
    return "".join(section(k.capitalize(), v) for k, v in guide.asDict().items())


def serve(reader: Reader, port: int = 8501, host: str = "127.0.0.1", most: int = 64 << 20) -> HTTPServer:
    """The server, which ``serve_forever`` runs. Uploads are of ``most`` bytes at most."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: str, status: int = 200) -> None:
            data = PAGE.format(body=body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send("" if self.path == "/" else section("Not found", self.path), 200 if self.path == "/" else 404)

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > most:
                return self._send(section("Too large", f"{size} bytes"), 413)
            data = self.rfile.read(size)
            try:
                if self.path == "/ask":
                    form = parse_qs(data.decode())
                    return self._send(answered(reader, form.get("question", [""])[0], int(form.get("k", ["5"])[0])))
                if self.path == "/read":
                    return self._send(guided(reader, data))
            except Exception as e:  # a job's failure is the request's
                return self._send(section("It failed", f"{type(e).__name__}: {str(e)[:500]}"), 500)
            return self._send(section("Not found", self.path), 404)

        def log_message(self, *what) -> None:
            pass

    return HTTPServer((host, port), Handler)
