"""Answers for the download source, without a network."""

ENTRY = """<entry><id>http://arxiv.org/abs/{n}</id><title>Paper
 {n}</title><summary>About {n}.</summary><link title="pdf" type="application/pdf" href="http://pdf/{n}"/></entry>"""


def fetch(url: str) -> bytes:
    if url.startswith("http://pdf/"):
        if url.endswith("/3"):
            raise OSError("gone")
        return b"%PDF " + url.encode()
    from urllib.parse import parse_qs, urlparse

    asked = parse_qs(urlparse(url).query)
    start, size = int(asked["start"][0]), int(asked["max_results"][0])
    entries = "".join(ENTRY.format(n=n) for n in range(start, min(start + size, 5)))
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{entries}</feed>'.encode()
