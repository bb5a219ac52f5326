"""Operators 3, 7 and 9: held-out accuracy, brute force and exact texts."""

import math
import random
import time
import re

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from rowloom.llm import html, language, secrets


def ppm_bits(tree, order, data):
    """Code length by the definition, a byte at a time."""
    total, data = 0.0, b"\n" * order + data
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            context = data[i - k:i]
            seen = {}
            for gram, n in tree.items():
                whole = gram.to_bytes(order + 1, "big")
                if whole[order - k:order] == context:
                    seen[whole[-1]] = seen.get(whole[-1], 0) + n
            if not seen:
                continue
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (sum(seen.values()) + len(seen)))
                break
            total -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
    return total


def test_code_lengths_by_definition():
    texts = {"a": [b"the cat sat", b"the hat"], "b": ["die köpfe".encode(), b"der hut"]}
    trees = []
    for data in texts.values():
        keys, n = np.unique(language.grams(data, 2)[0], return_counts=True)
        trees.append(dict(zip(keys.tolist(), n.tolist())))
    model = language.Model(list(texts), 2, trees)
    probes = [b"the hut", b"", b"z\x00", "der köter".encode()]
    want = [[ppm_bits(t, 2, p) for t in trees] for p in probes]
    assert np.allclose(model.bits(probes), want, atol=1e-3)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("x"))
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 200
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_of_odd_rows(docs):
    learn = [(i, "the cat sat on the mat with the hat") for i in range(50, 80)]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs(*ODD, *learn), least=1).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "und"), (None, "en")} <= got
    assert language.identify(docs(*ODD, *learn)).count() == len(ODD) + 30
    assert {r.lang_pred for r in language.identify(docs(*ODD).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs()).count() == 0 and language.accepted(docs(), 0.4).count() == 0
    assert language.accepted(docs(*ODD, *learn), 0.4).columns == docs().columns


def test_a_rare_language_has_a_tree(spark):
    """One short labelled text is enough, and too many labels are refused before any is left out."""
    rows = [(i, "the cat sat on the mat with the hat", "en") for i in range(60)] + [(i, "żółw źdźbło łąka", "pl") for i in (61, 62, 63, 64, 65, 66, 67, 68)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(table).collect()}
    assert {p for i, p in got if i > 60} == {"pl"} and {p for i, p in got if i < 60} == {"en"}
    many = spark.range(5000).select("id", F.lit("a b").alias("text"), (F.col("id") % 900).cast("string").alias("lang")).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="languages"):
        language.identify(many)


def brute_spans(text):
    """The rules as they are stated: all matches, then those that are too short dropped."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_rules_by_brute_force():
    draw = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ":", '"', "'", " ", "\n", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "aé", "toKen", "x.y/z", "aaaa"]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert [s[:3] for s in secrets.base_spans(text)] == brute_spans(text)


def test_best_tags_by_brute_force():
    draw = np.random.default_rng(2)
    field = secrets.Field(draw.normal(0, 1, (sum(secrets.OWN_SIZES + secrets.AROUND_SIZES), 3)), draw.normal(0, 1, (3, 3)))
    for n in (1, 2, 6):
        scores = draw.normal(0, 2, (n, 3))
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        full = np.concatenate([np.full((len(paths), 1), secrets.O), paths, np.full((len(paths), 1), secrets.O)], 1)
        values = scores[np.arange(n), paths].sum(1) + field.moves[full[:, :-1], full[:, 1:]].sum(1)
        assert field.decode(scores).tolist() == paths[values.argmax()].tolist()


def test_sure_tokens_do_not_change_the_best_tags():
    draw = np.random.default_rng(5)
    weights = draw.normal(0, 1.5, (sum(secrets.OWN_SIZES + secrets.AROUND_SIZES), 3))
    field = secrets.Field(weights, draw.normal(0, 0.3, (3, 3)))
    held = secrets.Tokens()
    for size in (1, 3, 40):
        tokens = [draw.choice(["word", "x9Y8z7", "password=", "A1B2", '"hash"', "."]) for _ in range(size)]
        numbers, bounds = np.asarray([held[t] for t in tokens]), np.asarray([0, size])
        table = np.asarray(held.table)
        index = secrets.features(numbers, table, 1)
        scores = weights[index].sum(1)
        assert field.tag(numbers, table, bounds, np.asarray([1])).tolist() == field.decode(scores).tolist()


def test_secret_scan(docs, spark):
    rows = [(100 + i, f"some words here then password={'%018x' % (i * 7919**3)} and further words that go on for a while " * 2) for i in range(30)]
    got = secrets.scan(docs(*ODD, *rows)).collect()
    assert len(got) == len(ODD) + 30
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("field")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in secrets.KINDS[:3])
        if (r.doc_id or 0) >= 100:
            assert r.n_assign == 2 and "password=[secret]" in r.text
    learnt = secrets.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    text = "here is my pwd= xK8sj2LmQ9vT4wZ1bN and then nothing else of any interest to anyone"
    found = secrets.spans_of([text, "plain words only, no more"], learnt, secrets.Tokens())
    assert [(text[s:e], k) for s, k, e, _ in found[0]] == [("xK8sj2LmQ9vT4wZ1bN", 3)] and found[1] == []
    assert secrets.scan(docs()).count() == 0
    assert secrets.redact(docs(*ODD, *rows)).columns == docs().columns


def test_every_table_has_a_field(docs):
    prose = [(i, f"the token of day {i} is a secret that no password keeps and so on") for i in range(40)]
    learnt = secrets.fit(docs(*prose, (None, "")).select("doc_id", "text"))
    text = "here is my pwd= xK8sj2LmQ9vT4wZ1bN and then nothing else of any interest to anyone"
    assert [(text[s:e], k) for s, k, e, _ in secrets.spans_of([text], learnt, secrets.Tokens())[0]] == [("xK8sj2LmQ9vT4wZ1bN", 3)]
    assert secrets.fit(docs((None, "a b")).select("doc_id", "text")) is not None
    assert secrets.own("a1" * 100 + "b2" * 200) != secrets.own("a1" * 300)


def test_redaction_of_overlapping_spans():
    assert secrets.redacted("ab token=0123456789abcdef01234567 z", secrets.base_spans("ab token=0123456789abcdef01234567 z")) == "ab token=[secret] z"
    assert secrets.redacted("x", []) == "x"


PAGE = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy &amp; go</div><article><h1>Head  line</h1><p><b>One&nbsp;two<br>three <i>f</i>our<p>A &lt; b</p><!-- <p>gone</p> --></article>
<section id="comments"><p>nice text</p></section><footer>&copy; x</footer></body>"""


def test_leaves_of_broken_markup():
    assert [t for _, t, _ in html.leaves(PAGE)] == ["Home", "Buy & go", "Head line", "One two", "three four", "A < b", "nice text", "© x"]
    assert html.leaves("") == [] and html.leaves("<p") == [(("p",), "<p", 0)] or html.leaves("<p") == [((), "<p", 0)]
    assert [t for _, t, _ in html.leaves("a<script>x")] == ["a"]


def test_silent_elements_do_not_swallow_the_page():
    texts = lambda page: [t for _, t, _ in html.leaves(page)]
    assert texts('<article><p>one <svg class="i"/> two</p><p>three</p></article>') == ["one two", "three"]
    assert texts('<p>one <svg a="x>y"><text>no</text></svg > two</p>') == ["one two"]
    assert texts("<p>a <math><mi>x</mi><mo>+</mo><mi>y</mi></math> b<p>c <math/> d") == ["a x+y b", "c d"]
    for tag in ("svg", "object", "noscript", "iframe", "template", "title"):
        assert [t for t in texts(f"<p>a</p><{tag}><p>b</p>") if t in "ab"] == ["a", "b"]
    assert texts("<p>a</p><noscript><p>turn it on</p></noscript><object data=x><p>instead</p></object><p>b</p>") == ["a", "turn it on", "instead", "b"]
    assert html.leaves("<noscript>n</noscript>x") == [(("noscript",), "n", 0), ((), "x", 0)]
    assert texts("<title>t</title><title-bar>kept</title-bar><script>no</script x>a<style>b") == ["kepta"]
    assert len(texts("<svg><p>x" * 20_000)) == 20_000


@pytest.mark.parametrize("page,blocks", [
    ('<b "x' * 200_000, 1), ("<p>it's <a b=' c " * 60_000, None), ("<div>" * 60_000 + "<p>x" * 60_000, 60_000), ("<b" * 400_000, 1),
    ("<b>" * 100_000 + "<p>x" * 100_000, 100_000), ("<b \"'" * 200_000, 1), ("</x>" * 100_000 + "<i>" * 100_000 + "</x>" * 100_000, 0),
    ("".join(f'<div class="c{i}">t' for i in range(40_000)), 40_000), ("<!" * 400_000, 1), ("<svg " * 200_000, 1), ("</p" * 300_000, 1)])
def test_odd_pages_are_read_in_linear_time(page, blocks):
    """About a megabyte each; every one of them used to take minutes or hours."""
    start = time.time()
    found = html.leaves(page)
    assert time.time() - start < 8 and (blocks is None or len(found) == blocks)


def test_gradient_is_the_losss_slope():
    pages = [html.leaves(PAGE), html.leaves("<main><p>x</p></main>")]
    marks = [html.teacher(p) for p in pages]
    model = html.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    paths, bag = html.vectors(pages, html.Hashes())
    sizes, truth = np.asarray([len(p) for p in pages]), np.asarray([m for f in marks for m in f], float)

    def loss():
        p = np.clip(model.scores(paths, bag, sizes), 1e-9, 1 - 1e-9)
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).sum() / len(sizes)

    gradient = model._gradient(paths, bag, sizes, truth)
    for k in ("hf", "hb", "cf", "cb", "xf"):
        at = np.unravel_index(np.abs(gradient[k]).argmax(), gradient[k].shape)
        model.p[k][at] += 1e-2
        up = loss()
        model.p[k][at] -= 2e-2
        slope = (up - loss()) / 2e-2
        model.p[k][at] += 1e-2
        assert slope == pytest.approx(gradient[k][at], rel=0.05, abs=1e-3)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit("x"))
    odd = spark.createDataFrame([(9001, None, None, "x"), (9002, "u", "", "x"), (9003, "u", PAGE, "x"), (None, "u", PAGE, "x")], pages.schema)
    got = {r.page_id: r for r in html.extract(pages.unionByName(odd)).collect()}
    assert got[9001].text == got[9002].text == "" and got[9003].text == got[None].text == "Head line One two three four A < b"
    wrong = 0
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        want = " ".join(" ".join(t.split()) for t in map(html.markup.unescape, re.split("(?:</?(?:p|h1|br)>)+", re.sub("</?b>", "", article))) if t.split())
        wrong += got[r.page_id].text != want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert wrong == 0
    assert html.extract(pages.limit(0)).count() == 0


def test_long_pages_are_fitted_and_labelled(spark):
    line = "a sentence of the story that goes on for quite a while, so that it is no heading "
    item = lambda i: f"<h2>Part {i}</h2><p>{line * 3}{i}.</p><p>Yes {i}.</p><ul><li>item {i}</li></ul>"
    inside = "".join(map(item, range(150)))
    menu = "<nav><ul>" + "".join(f"<li><a href=x>place {i}</a></li>" for i in range(9)) + "</ul></nav>"
    end = "<div class=comments><p>so nice, thank you for this story</p></div><footer><p>all rights reserved</p></footer>"
    pages = [(i, "u", f"<body>{menu}<div class=text>{inside}</div>{end}<p>{i}</p></body>") for i in range(12)]
    got = html.extract(spark.createDataFrame([*pages, (None, "u", pages[0][2])], "page_id long, url string, html string")).collect()
    assert len(got) == 13 and all(len(h) > 20_000 for _, _, h in pages)
    for r in got:
        assert all(f"Part {i} {line * 3}{i}. Yes {i}. item {i}" in r.text for i in range(149))
        assert "place" not in r.text and "thank you" not in r.text and "reserved" not in r.text


def test_the_labeller_always_decides(spark):
    schema = "page_id long, url string, html string"
    for made in (["<p>short one</p><footer>x</footer>"], []):
        frame = spark.createDataFrame([(None, "u", h) for h in made], schema)
        model = html.fit(frame)
        page = html.leaves(PAGE)
        marks = model.scores(*html.vectors([page], html.Hashes()), np.asarray([len(page)])) >= 0.5
        assert marks.tolist() == [False, False, True, True, True, True, False, False], made


def test_blocks_of_the_fit_reach_the_end_of_a_page():
    assert html.places(80) == list(range(80))
    at = html.places(1000)
    assert len(at) == 80 == len(set(at)) and at == sorted(at) and at[0] == 0 and at[-1] == 999 and 500 in at
    assert html.vectors([[((), "x", 0)] * 80], html.Hashes(), 1000)[1][-1, html.WORDS + 4] == np.float32(0.999)
