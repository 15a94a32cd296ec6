"""Centroid clusters and spelling variants against brute force, main texts of planted pages."""

import hashlib
import random
import zlib
from collections import Counter
from re import findall

import numpy as np
import pytest

from parlance.llm import centroid_clusters as cc
from parlance.llm import html_text as ht
from parlance.llm import spelling_variants as sv


# centroid clusters


def lloyd(x, c, rounds):
    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        of, _ = nearest()
        for j in set(of.tolist()):
            c[j] = [int(s) // int((of == j).sum()) for s in x[of == j].sum(0)]
    return *nearest(), c


def vectors_file(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("spread", [1, 400])
def test_clusters_equal_lloyd(spark, tmp_path, spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (1500, 64))  # a small spread makes ties
    x[300:600] = x[0]
    rows = [(int(i % 1400), [float(v) / 256 for v in r], None, "x") for i, r in enumerate(x)]
    bad = [(9000, None, 1, "x"), (9001, [0.0] * 63, 1, "x"), (9002, [float("nan")] + [0.0] * 63, 1, "x"), (9003, [None] + [0.0] * 63, 1, "x"), (9004, [float("inf")] + [0.0] * 63, 1, "x")]
    got = cc.op11_centroid_clusters(spark, vectors_file(spark, tmp_path, rows + bad)).collect()
    ids = [r[0] for r in rows]
    first = sorted(range(1500), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:40]
    of, d, c = lloyd(x, x[first].copy(), 5)
    want = Counter((ids[i], int(of[i]), int(d[i]), int(d[of == of[i]].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[of[i]])).encode()).hexdigest()) for i in range(1500))
    assert Counter(tuple(r) for r in got) == want


def test_clusters_of_few_and_no_vectors(spark, tmp_path):
    few = [(1, [1.0] * 64, 0, "x"), (2, [-1.0] * 64, 0, "x"), (None, [0.004] * 64, 0, "x")]
    got = {r.vec_id: (r.distance, r.inertia) for r in cc.op11_centroid_clusters(spark, vectors_file(spark, tmp_path / "a", few)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), None: (0, 0)}
    assert cc.op11_centroid_clusters(spark, vectors_file(spark, tmp_path / "b", [])).collect() == []


def test_bounds_certify_and_adapt():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (24, 64))
    x = np.concatenate([c + rng.integers(-150, 150, (200, 64)) for c in centres])
    c = x[rng.permutation(len(x))[:24]].copy()
    s = cc.Bounds(x, 6)
    s.scan(np.arange(len(x)), c)
    looked = []
    for step in range(8):
        of = s.cluster
        new = np.array([x[of == j].sum(0) // max(1, (of == j).sum()) if (of == j).any() else c[j] for j in range(24)])
        s.narrow(max(2, 6 - step))
        s.move(cc.above(cc.distance_to(new, c)))
        s.settle(new)
        c = new
        assert (s.cluster == cc.distances(x, c).argmin(1)).all()
        looked.append((s.used > 0).mean())
    assert looked[-1] < 0.5  # most vectors aren't looked at again


def test_largest_components_are_exact():
    x = np.array([[cc.LARGEST - 1] * 64, [-cc.LARGEST + 1] * 64])
    assert cc.distances(x, x)[0, 1] == 64 * (2 * cc.LARGEST - 2) ** 2 == cc.distance_to(x[:1], x[1:])[0]


# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("size", [sv.BLOCK, 25])
def test_variants_equal_brute_force(spark, size, monkeypatch):
    rng = random.Random(size)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.choice([6, 6, 7, 8]))) for _ in range(700)} | {"a" * n for n in range(6, 12)} | {"aaaaab" + "z" * 40, "aaaaab" + "z" * 41}
    counts = {w: int(5 ** rng.uniform(1, 5)) for w in words}
    found = sv.near_words
    monkeypatch.setattr(sv, "near_words", lambda w: found(w, size))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(sv.variants(df)) == brute(counts)


def test_long_chain_of_forms(spark):
    counts = {"abcdefghij" + "x" * i: 5 ** (i + 1) for i in range(9)}
    assert {r[2] for r in rows_of(sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))} == {"abcdefghij" + "x" * 8}


def test_counted_words(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["Straße", "stráße", "ÉCLAIRS", "éclairs", "letters1letters", "naïveté", "shorter", "five5"]) for _ in range(300)), "x") for i in range(40)]
    texts += [(None, "letters " * 900, "x"), (90, None, "x"), (91, "", "x"), (92, "q" * 30000, "x"), (93, "q" * 30000 + " " + "q" * 29999, "x"), (93, "shorter " * 9, "x")]
    want = Counter()
    for doc_id, text, _ in texts:
        for run in findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    spark.createDataFrame(texts, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(sv.op12_spelling_variants(spark, str(tmp_path))) == brute({w: n for w, n in want.items() if len(w) >= 6 and n >= 5})
    long = spark.createDataFrame([("q" * 30000, 9), ("q" * 29999, 90)], "word string, n long")
    assert [r[4] for r in rows_of(sv.variants(long))] == [1, 1]
    assert rows_of(sv.variants(long.limit(0))) == []


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        tree = sv.WaveletTree(values)
        lo, least = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        hi, end = rng.integers(lo, n + 1), rng.integers(least, n + 1)
        query, value = tree.report(lo, hi, least, end)
        want = sorted((q, int(v)) for q in range(200) for v in values[lo[q] : hi[q]] if least[q] <= v < end[q])
        assert sorted(zip(query.tolist(), value.tolist())) == want


# html


def text_of(page):
    found = ht.elements(ht.parsed(page))
    ht.hashed(found)
    article = ht.article_of(found)
    return "\n".join(ht.blocks(article or found[0], article))


CASES = {
    "": "",
    "no markup &amp; a\xa0 b": "no markup & a b",
    "a < b &lt;i&gt; <b>bold</b>ly &#233;&eacute": "a < b <i> boldly éé",
    "<p>one<p>two<br>three<div>four</p>five</div>six": "one\ntwo three\nfour\nfive\nsix",
    "<article><header><h1>T</h1></header><p>x <i>y</i>\n z<footer>tags</footer></article><p>out": "T\nx y z",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd",
    "<table><tr><td>1<td>2<tr><th>3</table>": "1\n2\n3",
    "<p title='a>b' data-x=\"</p>\">kept</p><script>if (a</b) '<p>no'</script ><style>p{}</style><!-- <p>no --><p>too": "kept\ntoo",
    "<p title=\"never closed>x<p>y": "x\ny",
    "<main><div class='cookie-banner'>We use</div><p>Text</p><aside>side</aside><form><p>mail</p></form></main>": "Text",
    "<article><p>Body text is here</p><section id='comments'><article class='comment'><p>Reader says much more than the body did</p></article></section></article>": "Body text is here",
    "<article><p>Short</p></article><section class='comments'><article><p>Readers say much more than the body</p></article></section>": "Short",
    "<body class='has-sidebar'><div id='header'>Site</div><div class='content menu-open'><p>The text of the page, which is long.</p></div><div class='sidebar'>links</div>": "The text of the page, which is long.",
    "<body><ul><li><a>Home</a><li><a>News</a></ul><p>Words with <a>a link</a>.</p><div hidden>x</div><div style='display: none'>y</div><noscript>z</noscript>": "Words with a link.",
    "<article><p>x</p><div class=adSlot>buy</div><div class='ads-1'>buy</div><div role=complementary>more</div></article>": "x",
    "<div>" * 3000 + "deep" + "</div>" * 2999: "deep",
    "<article>unclosed <b>bold <p>next": "unclosed bold\nnext",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_main_text(page):
    assert text_of(page) == CASES[page]


def planted():
    """A host of pages without an article element, whose template only recurrence shows; one of a hundred
    copies; one of near copies; one page alone."""
    rng, rows, want = random.Random(2), [], {}
    words = lambda n: " ".join("".join(rng.choice("aeioubdt") for _ in range(5)) for _ in range(n))
    box, tail = words(12), words(9)

    def add(host, page, text):
        want[len(rows)] = text
        rows.append((len(rows), host and f"https://{host}/{len(rows)}", page, "t"))

    for _ in range(12):
        mine = [words(30), words(20)]
        add("soup.example", f"<body><div><div>{box}</div><span>{tail}</span></div><div><p>{mine[0]}</p><p>{mine[1]}</p></div><div><p>{tail}</p></div>", "\n".join(mine))
    whole = [words(40), words(20)]
    for _ in range(100):
        add("copies.example", f"<article><p>{whole[0]}</p><p>{whole[1]}</p></article>", "\n".join(whole))
    for i in range(30):
        near = [f"{whole[0]} {i}", words(15) if i else whole[1], words(15)]
        add("near.example", f"<article><p>{near[0]}</p><p>{near[1]}</p><p>{near[2]}</p><div><p>{tail}</p></div><p>{box}</p></article>", "\n".join(near))
    add("alone.example", f"<body><div>{box}</div><p>{tail}</p>", f"{box}\n{tail}")
    add(None, f"<body><p>{box}</p>", box)
    add("alone.example", None, "")
    add("//odd url", "", "")
    rows[-1] = (rows[-1][0], "no host here", "", "t")
    return rows, want


@pytest.mark.parametrize("broadcast_rows", [ht.BROADCAST_ROWS, 0])
def test_recurring_subtrees_of_a_host_go(spark, broadcast_rows):
    rows, want = planted()
    pages = ht.with_hosts(spark.createDataFrame(rows, "page_id long, url string, html string, template string").select("page_id", "url", "html"))
    got = {r.page_id: r.text for r in ht.extracted(pages, ht.templates(pages), broadcast_rows).collect()}
    assert got == want


def test_query_over_odd_tables(spark, tmp_path):
    rows = [(1, "http://h/a", "<p>x</p>", "s"), (1, "http://h/a", "<p>x</p>", "s"), (None, None, None, "s")]
    schema = "page_id long, url string, html string, host string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/pages.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/pages.parquet")
    got = sorted(ht.op13_html_text(spark, f"{tmp_path}/a").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "http://h/a", "x", 1)] * 2 + [(None, None, "", 0)]
    assert ht.op13_html_text(spark, f"{tmp_path}/b").collect() == []
