import base64
import hashlib
import re

from pagelens.llm import quotes, urlfilter, warc


def test_digest_array(tmp_path, monkeypatch):
    entries = [f"host{i}.example" for i in range(500)] + ["", "ü.example/ä", "host1.example"]
    urlfilter.DigestArray.write(tmp_path / "a.bin", entries)
    array = urlfilter.DigestArray(tmp_path / "a.bin")
    keys = [e.encode() for e in entries] + [b"host500.example", b"HOST1.example"]
    assert array.contains(keys).tolist() == [True] * len(entries) + [False, False]
    monkeypatch.setattr(urlfilter, "digest", lambda e: len(e))  # every string of one length collides
    urlfilter.DigestArray.write(tmp_path / "b.bin", entries)
    assert urlfilter.DigestArray(tmp_path / "b.bin").contains(keys).tolist() == [True] * len(entries) + [False, False]
    urlfilter.DigestArray.write(tmp_path / "c.bin", [])
    assert urlfilter.DigestArray(tmp_path / "c.bin").contains([b"a"]).tolist() == [False]


URLS = [
    None, "", "nonsense", "http://", "http://A.Org", "http://a.org/", "https://www.EXAMPLE.org/es/x?q", "http://example.org/en/12", "http://example.org/EN/1", "http://badexample.org/es/", "ftp://x.com/fr/a#b", "http://x.com/de/", "http://x.com:80/de/",
    "http://spam.test/a/b", "http://m.spam.test/", "http://nospam.test/", "http://dir.test/bad/x", "http://dir.test/badly", "http://page.test/one.html?x", "http://page.test/one.htmlx", "x://http://y.com/fr/", "http://a.b/\n/c",
]
ENTRIES = ["spam.test", "dir.test/bad/", "page.test/one.html", None, "spam.test"]


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hosts = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
    listed = any(h == e.partition("/")[0] and ("/" not in e or path == e[e.index("/") :] or (e.endswith("/") and path.startswith(e[e.index("/") :]))) for h in hosts for e in ENTRIES if e)
    return host, path, None, "block" if listed and host else "allow"


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "listed", "host") for i, u in enumerate(URLS + URLS[:5])] + [(None, "http://spam.test", "x", "y")], "page_id long, url string, listed string, host string")
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    for most in (100, 1):  # one mapped array, and one for each entry
        got = urlfilter.judge(pages, entries, max_entries=most).collect()
        assert len(got) == len(URLS) + 6
        for r in got:
            url = "http://spam.test" if r.page_id is None else (URLS + URLS[:5])[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url), url
    assert urlfilter.judge(pages.limit(0), entries).count() == 0


def test_warc_ignores_columns_with_its_own_names(spark):
    rows = [(1, "http://a.org/", "<p>x</p>", "b", "id"), (None, None, None, None, None)]
    got = warc.derive(spark.createDataFrame(rows, "page_id long, url string, html string, block string, record_id string")).collect()
    assert len(got) == 6 and {r.block for r in got if r.record_type == "conversion"} == {"x", ""}
    assert warc.derive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip(spark):
    html = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><script>var t='</p>'</script><p>One&nbsp;two<br>three <b>x</b></p><!-- gone --><ul><li><a href='/x'>L</a></li></ul></body></html>"
    rows = [(1, "http://a.org/ü", html, {"Content-Type": "text/html", "Server": "s"}, None), (2, None, None, None, "2020-01-01T00:00:00Z"), (1, "http://a.org/ü", html, {"Content-Type": "text/html", "Server": "s"}, None), (3, "u", "x" * 200_000, {}, None), (None, "u", "<", {"A": None}, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, headers map<string,string>, date string")
    got = warc.serialised(warc.derive(pages)).collect()
    assert len(got) == 3 * len(rows)
    ids = {r.record_id: r for r in got}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in got:
        headers, block = warc.parse(bytes(r.bytes))
        named = dict(headers)
        assert block == r.block.encode() and r.block_digest == sha(block) == named["WARC-Block-Digest"]
        if r.record_type == "response":
            assert r.payload_digest == sha(block.split(b"\r\n\r\n", 1)[1])
        else:
            source = ids[named["WARC-Refers-To"]]
            assert source.record_type == "response" and source.target_uri == r.target_uri and source.date == r.date
            assert r.source_digest == source.payload_digest and [v for k, v in headers if k == "WARC-Source-Header"] == [h for h in source.source_headers.split("\n") if h]
    text = next(r.block for r in got if r.page_id == 1 and r.record_type == "conversion")
    assert text == "A & B\nOne two\nthree x\nL"
    fields = next(r.block for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert fields.startswith("title: A &amp; B\r\n") and "links: 1\r\n" in fields
    assert warc.derive(pages.limit(0)).count() == 0


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "First question about\nmany things.\n\nSecond paragraph here"),
        (1, 1, "assistant", "An answer to it"),
        (1, 2, "user", "Another topic"),
        (1, 3, "assistant", "On Monday someone wrote:\n> first  QUESTION about many\n> things.\n\nA late reply"),
        (1, 4, "user", "> > Second paragraph here\n> A late reply\n\nDeep reply"),
        (1, 5, "user", "> never said\nNo link"),
        (1, 6, "user", "> later text\nEarly"),
        (1, 7, "user", "later text"),
        (2, 0, "user", "> Another topic\nOther conversation"),
        (2, 1, None, None), (2, 1, "user", "same turn"), (2, 0, "user", "> Another topic\nOther conversation"),
        (None, 3, "user", "> Another topic"), (3, None, "user", "> x"), (3, 1, "user", "> " * 300 + "deep\n" + "word " * 20_000),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = {(r.conv_id, r.turn, r.role): r for r in quotes.link_quotations(frame).collect()}
    assert len(got) == len(rows) - 1
    at = lambda t: got[1, t, "assistant" if t in (1, 3) else "user"]
    assert (at(3).parent_turn, at(3).thread_turn, at(3).depth, at(3).text) == (0, 0, 1, "A late reply")
    assert (at(4).parent_turn, at(4).thread_turn, at(4).depth, at(4).n_quoted, at(4).n_linked) == (3, 0, 2, 2, 2)
    assert at(4).text == "Deep reply" and at(4).chat == "<|user|>\nDeep reply\n"
    assert (at(5).parent_turn, at(5).n_quoted, at(5).thread_turn) == (None, 1, 5) and at(6).parent_turn is None
    assert got[2, 0, "user"].parent_turn is None and got[2, 1, None].text == ""
    order = [r.turn for r in quotes.link_quotations(frame).collect() if r.conv_id == 1]
    assert order == [0, 3, 4, 1, 2, 5, 6, 7]
    assert quotes.link_quotations(frame.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(7, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(40)]
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.thread_turn, r.depth) for r in got] == [(i, 0, i) for i in range(40)]
