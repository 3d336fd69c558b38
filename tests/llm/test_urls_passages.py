import hashlib
import re
from collections import Counter

import pytest

from palisade.llm import queries, substring_dedup, url_filter

URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1?x=1#t", "http://example.com/en/9",
    "http://m.example.com/en/9", "http://m.example.com/fr/9", "https://x.net/es/1", "https://net/es/", "https://x.net/en/1/?utm_source=f&a=1",
    "http://x.net/en/1?a=1", "http://www.x.net:80/en/1?a=1&ref=z", "http://x.net/en/2", "ftp://q.org/a://b", "http://xcom/", "http://é.org/ü?",
    "http://badexample.com/en/9", "http://x.net?u=http://y.com/", "http://x.net/en/1?a=1",
]


def brute(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if brute_form(url) in listed else "allow"


def brute_form(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    site = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(site):]).group()
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    parts = [p for p in (query.group(1) if query else "").split("&") if p and not re.match("(utm_[a-z]+|ref)=", p)]
    site = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", re.sub("[A-Z]", lambda m: m.group().lower(), site)))
    return site + path.rstrip("/") + ("?" + "&".join(parts) if parts else "") if site else None


@pytest.mark.parametrize("listed", [[], ["https://x.net/en/1?a=1", None, "junk", "http://é.org/ü", "http://x.net/en/1?a=1#z"]])
def test_verdicts_against_brute_force(spark, listed):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, form string")
    table = spark.createDataFrame([(u,) for u in listed], "url string")
    got = url_filter.verdicts(pages, table, queries.RULES).collect()
    forms = {brute_form(u) for u in listed} - {None}
    assert sorted((r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in got) == [
        (i, brute(u, forms)) for i, u in enumerate(URLS)]


def test_a_full_filter_gives_no_wrong_answer(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.org/{i}") for i in range(2000)], "page_id long, url string")
    listed = pages.where("page_id % 3 = 0").select("url")
    lanes, blocks = url_filter.bloom(listed.select(url_filter.canonical(listed["url"]).alias("form")), most_blocks=1)
    assert blocks == 1 and lanes.count() == 1
    got = url_filter.verdicts(pages, listed, ()).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.verdicts(pages, pages.select("url"), queries.RULES).count() == 0


def brute_repeats(rows, length):
    first = {}
    split = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t, *_ in rows]
    for i, words in split:
        for k in range(len(words) - length + 1) if i is not None else ():
            window = tuple(words[k:k + length])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - length + 1) if i is not None else ():
            if first[tuple(words[k:k + length])] < i:
                gone.update(range(k, k + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return Counter(out)


@pytest.mark.parametrize("length,texts", [(13, True), (13, False), (4, True)])
def test_repeats_against_brute_force(docs, rows, length, texts):
    got = substring_dedup.without_repeats(docs, length, texts).collect()
    want = Counter(x if texts else x[:4] for x in brute_repeats(rows, length).elements())
    assert Counter(tuple(r) for r in got) == want


def test_repeats_when_the_anchors_are_joined(monkeypatch, docs, rows):
    """The way taken beyond the bound of the bitmap, and anchors of very many documents."""
    defaults = substring_dedup.stretches.__defaults__
    monkeypatch.setattr(substring_dedup.stretches, "__defaults__", (3, *defaults[1:]))
    monkeypatch.setattr(substring_dedup, "WIDE", 2)
    got = substring_dedup.without_repeats(docs, 13).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows, 13)


def test_no_documents(empty):
    assert substring_dedup.without_repeats(empty).count() == 0
