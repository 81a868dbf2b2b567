"""Chat, HTML, WARC, quality, top-k, URL and mixing operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.llm.chat import render_chats
from siltstream.llm.html import blocks, default_field, extract_main_text, main_text
from siltstream.llm.html_examples import labelled_pages
from siltstream.llm.mixing import mix_sources
from siltstream.llm.quality import is_held_out, score_quality, train_quality
from siltstream.llm.shared import new_path
from siltstream.llm.topk import exact_top_k
from siltstream.llm.urls import RULES, filter_urls, seed_urls, train_url_filter
from siltstream.llm.warc import parse_archive, read_warc, transactions, write_warc

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- chat
def test_snapshots_collapse_to_maximal_conversations(spark):
    r = random.Random(2)
    turns = {}
    for c in range(60):
        base = turns[r.choice(list(turns))] if turns and r.random() < 0.6 else []
        own = base[: r.randint(0, len(base))] + [(r.choice(["user", "assistant", None]), r.choice(["hi", "a", "b", "", None])) for _ in range(r.randint(0, 3))]
        turns[c] = own or [("user", "x")]
    turns[99] = [("user", str(i)) for i in range(700)]  # more than one block of turns
    turns[98] = turns[99][:300]
    rows = [(c, 3 * i, a, t, "extra") for c, ts in turns.items() for i, (a, t) in enumerate(ts)] + [(None, 0, "user", "lost", "x")]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, rendered string")
    got = {x.conv_id: (x.n_turns, x.copies, x.rendered) for x in render_chats(table).collect()}
    want = {}
    for c, ts in turns.items():
        copies = [d for d, o in turns.items() if o == ts]
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts for o in turns.values())
        if not longer and c == min(copies):
            want[c] = (len(ts), len(copies), "".join(f"<|{a or 'unknown'}|>\n{t or ''}<|end|>\n" for a, t in ts))
    assert got == want
    assert render_chats(table.limit(0)).count() == 0


# ---------------------------------------------------------------- HTML
def test_field_labels_unseen_layouts():
    field = default_field()
    pages = [field.read(p) for p in labelled_pages(150, seed=91)]
    wrong = sum(x != b.main for p in pages for b, x in zip(p, field.decode(p), strict=True))
    assert wrong <= 0.015 * sum(map(len, pages))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav>", ""),
        ("<title>no</title><nav><li><a>Menu</a></nav><article><h1>Head</h1><p>One &amp; two&nbsp; three<br>four <b>bo</b>ld<p>Last &lt;one&gt; here.", "Head One & two three four bold Last <one> here."),
        ("<article><script>var t='</p>';a<b</script><p>Text is here.</p><style>p{}</style><!-- note --><div class='ad'>Buy this now please.</div></article><footer>&copy; x</footer>", "Text is here."),
        ("<main><p>The story goes on and on.</p></main><section id=comments><div class=comment><p>I liked this story a lot.</p></div></section><aside>More</aside>", "The story goes on and on."),
    ],
)
def test_main_text_of_small_pages(page, text):
    assert main_text(page, default_field()) == text


def test_extraction_keeps_rows_and_other_columns(spark):
    rows = [(1, "<article><p>Some text is here.</p></article>", "x"), (2, None, "y"), (2, None, "y"), (3, "<" * 5000 + "<p title=\"a>b\" class='c'>" + "z " * 20000, "w")]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, html string, main_text string"))
    assert out.columns == ["page_id", "html", "main_text"] and out.count() == 4
    assert {r.main_text for r in out.filter("page_id <= 2").collect()} == {"Some text is here.", ""}


def test_extraction_from_test_pages(spark):
    import html as entities
    import re

    for r in extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inside = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        assert r.main_text == " ".join(entities.unescape(re.sub(r"</?(?:h1|p|br)>", " ", inside)).split())


# ---------------------------------------------------------------- WARC
def test_archives_round_trip(spark):
    tricky = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 20
    long = "x" * 150
    rows = [(5, "http://a", long), (3, None, long), (9, "u\r\nv", long), (4, "q", None), (6, "q", ""), (7, "q", "ab"), (8, "q", "ab"), (10, "é", tricky), (10, "é", tricky), (None, "n", long)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = new_path(spark, "warc-test")
    write_warc(table, path, captures_a_file=3)
    records = read_warc(spark, path)
    out = transactions(records).collect()
    got = sorted((str(r.page_id), r.capture.payload_bytes, r.capture.payload_digest, r.capture.record_type, r.capture.refers_to) for r in out)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = h == long and i in (5, 9)
        want.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", "<urn:page:3>" if revisit else None))
    assert got == sorted(want)
    assert all(r.request and r.metadata for r in out)
    assert {bytes(r.payload) for r in records.filter("record_type = 'response' and page_id = 10").collect()} == {tricky.encode()}
    assert records.count() == 3 * len(rows)
    empty = new_path(spark, "warc-test")
    write_warc(table.limit(0), empty)
    assert transactions(read_warc(spark, empty)).count() == 0


def test_parse_goes_by_lengths():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [b for _, b in parse_archive(one * 2)] == [b"ab\r\nc"] * 2


# ---------------------------------------------------------------- quality
def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train_quality(docs, labels, max_docs=1500)
    out = score_quality(docs, model).withColumn("held", is_held_out("doc_id")).join(labels, "doc_id").filter("held").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert len(bad) > 50 and (good[:, None] > bad[None, :]).mean() > 0.98
    assert (good >= 0.3).mean() > 0.98 and (bad < 0.3).mean() > 0.9


def test_quality_edge_cases(spark):
    table = spark.createDataFrame([(1, None, 2.0), (1, "", 3.0), (None, "a b", 1.0), (2, "w " * 30000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    train = spark.createDataFrame([(i, "good words in a row" if i % 2 else "*** ### $$$") for i in range(20)], "doc_id long, text string")
    model = train_quality(train, labels)
    out = score_quality(table, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert score_quality(table.limit(0), model).count() == 0
    assert {r.score for r in score_quality(table, train_quality(train, labels.limit(0))).collect()} == {0.5}
    only = train_quality(train, labels.filter("quality = 1"))
    assert all(r.score > 0.8 for r in score_quality(table, only).collect())


# ---------------------------------------------------------------- top-k
def brute_top(rows, k, every):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(4500)]  # more ties than a round leaves open
    rows += [(7000, None), (7050, [float("nan")] * 8), (7100, [None] + [0.1] * 7), (None, [0.1] * 8), (7150, [float("inf")] * 8), (8000, [0.3] * 3), (8001, [0.2] * 3)]
    table = spark.createDataFrame([(*x, "l") for x in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(x) for x in exact_top_k(table, row_block=512, query_block=16).collect())
    assert got == brute_top(rows, 5, 50)
    few = [(0, [0.1, 0.2]), (1, [0.3, -0.4]), (2, [0.0, 0.0])]
    assert sorted(tuple(x) for x in exact_top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()) == brute_top(few, 5, 50)
    assert exact_top_k(table.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs
def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


def test_url_rules_and_trees(spark):
    r = random.Random(6)
    parts = ["http", "://", ":", "/", "example.org", "X.ORG", "com", "/es/", "/en/1", "/fr/", "/de/", "?", "#", "a", "\n", "org", ".", "é"]
    urls = ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(3000)]
    urls += [f"https://{h}{p}" for h in ("a.example.org", "example.org", "badexample.org", "b.com", "ORG") for p in ("", "/", "/es/1", "/en/12", "/fr/", "/de/x?y")] + [None, ""]
    table = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, features int")
    model = train_url_filter(seed_urls(spark))
    for row in filter_urls(table, model).collect():
        host, path, best = brute_rule(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, best and best[1])
        assert row.verdict == best[0] if best else row.verdict in ("allow", "block")
    assert filter_urls(table.limit(0), model).count() == 0
    constant = train_url_filter(seed_urls(spark).filter("label = 0"))
    assert {x.verdict for x in filter_urls(table, constant).filter("rule is null").select("verdict").distinct().collect()} == {"allow"}


def test_trees_on_unseen_seeds(spark):
    model = train_url_filter(seed_urls(spark).filter("crc32(encode(url, 'utf-8')) % 5 <> 0"))
    held = seed_urls(spark).filter("crc32(encode(url, 'utf-8')) % 5 = 0")
    out = filter_urls(held.withColumn("page_id", F.monotonically_increasing_id()), model, rules=()).join(held, "url")
    assert out.agg(F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("double"))).first()[0] > 0.95


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, factor=1.5, weights=(5, 2, 1), most=2.0):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, full, out = factor * sum(sizes.values()), set(), {}
    while True:
        total = sum(weight[n] for n in names if n not in full)
        out.update({n: left * weight[n] / total if total else 0.0 for n in names if n not in full})
        over = [n for n in names if n not in full and out[n] > most * sizes[n] + 1e-9]
        if not over:
            return out
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            full.add(n)


def test_mix_meets_targets_and_repeats_itself(spark):
    r = random.Random(8)
    rows = []
    for i in range(4000):
        source = r.choice(["big"] * 8 + ["a", "b", "Z", "é", None])
        rows.append((i, r.choice([None, ""]) if r.random() < 0.02 else " ".join("w" * r.randint(1, 80)), source))
    rows += [(1, "same words here", "a"), (1, "same words here", "a"), (None, "no id", "b"), (None, "no id", "b"), (5000, "x", "tiny")]
    table = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, source string, target string, size int")
    run = lambda: sorted(map(str, mix_sources(table, group_rows=64, fan_in=4).collect()))
    out = mix_sources(table, group_rows=64, fan_in=4).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == run()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    for source, target in want.items():
        own = [x for x in out if x.source == source]
        assert abs(own[0].target - target) < 1e-6 * max(target, 1) and own[0].source_size == sizes[source]
        assert abs(sum(x.taken for x in own) - target) <= 80
    assert all(x.taken == x.copies * x.size and x.taken <= 2 * x.size for x in out)
    assert mix_sources(table.limit(0)).count() == 0
