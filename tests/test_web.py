import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

import pytest

from lectern.operators import providers
from lectern.plans import web
from lectern.plans.reader import Reader
from tests.test_pdf import PAGE, made


def served(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"


@pytest.fixture
def service():
    """A chat service that fails as often as it is told."""
    statuses = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            status = statuses.pop(0) if statuses else 400 if asked.startswith("bad") else 200
            data = json.dumps({"choices": [{"message": {"content": asked.upper()}}]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *what):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    yield served(server), statuses
    server.shutdown()


def test_calls_are_tried_again(service):
    url, statuses = service
    api = providers.ChatApi(url, "k", "m", retries=3, pause=0.01, per_second=200)
    statuses += [503, 429]
    assert api.complete("hello") == "HELLO"
    statuses += [500] * 4
    with pytest.raises(HTTPError):
        api.complete("x")
    assert not statuses
    with pytest.raises(HTTPError):
        api.complete("bad")  # not tried again
    with pytest.raises(OSError):
        providers.ChatApi("http://127.0.0.1:9", "k", "m", retries=1, pause=0.01).complete("x")


def test_a_failed_call_is_a_row_with_an_error(spark, service):
    df = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None)], "id long, prompt string")
    api = providers.ChatApi(service[0], "k", "m", retries=1, pause=0.01)
    rows = {x.id: x for x in providers.complete(df, api, error="error").collect()}
    assert (rows[1].answer, rows[1].error) == ("ONE", None) and rows[2].answer is None and "400" in rows[2].error and (rows[3].answer, rows[3].error) == (None, None)
    assert providers.complete(df.filter("id = 1"), api).columns == ["id", "prompt", "answer"]


def test_pages(spark, tmp_path):
    reader = Reader(spark, str(tmp_path), providers.HashEmbedder(), providers.EchoModel())
    reader.build(spark.createDataFrame([(1, "Cats sleep.\n\nDogs <bark>.")], "doc_id long, text string"))
    server = web.serve(reader, 0)
    url = served(server)
    assert "Ask the corpus" in urlopen(url).read().decode()
    page = urlopen(f"{url}/ask", urlencode({"question": "dogs & <cats>", "k": 1}).encode()).read().decode()
    assert "dogs &amp; &lt;cats&gt;" in page and "Answer from the passages." in page and page.count("<li>") == 1
    page = urlopen(f"{url}/read", made([PAGE])).read().decode()
    assert "<h2>Conclusion</h2><p>State the conclusion of this paper.</p>" in page
    assert "cannot be read" in urlopen(f"{url}/read", b"no pdf").read().decode()
    for path, data in (("/other", None), ("/other", b"x")):
        with pytest.raises(HTTPError):
            urlopen(url + path, data)
    server.shutdown()
