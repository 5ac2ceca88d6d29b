import hashlib
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidemark.llm import chat, html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">Cookies!</div>
<article><header><h1>Head  line</h1></header><p>One &lt;b&gt; two<br>three &amp;amp; <b>bold</b>text</p><!-- no --><p>Second<p>Third<ul><li>a<li>b</ul>
<aside>side</aside><form><p>name</p></form><div id="comments"><p>first!</p></div><div>tail</div></article>
<div class="sidebar">links</div><footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE, set()) == "Head line\n\nOne <b> two three &amp; boldtext\n\nSecond\n\nThird\n\na\n\nb\n\ntail"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<main><p>x</main>y", "x"), ("<article>a <script>x", "a"), ("a < b & c &nbsp; d", "a < b & c d"), ("<div role='navigation'>n</div><p>t", "t"), ('<p title="a>b">q</p>', "q"), ("<p hidden>h</p><p>v", "v"), ("<article><p>a</article><article><p>b</article>", "a\n\nb"), ("<table><tr><td>1<td>2</table>", "1\n\n2"), ("<textarea><p>x</textarea>y", "y"), ('<p class="x">unclosed "quote <b>bold', "unclosed \"quote bold"), ("<article class='post'><div class='article-header'><h1>T</h1></div>x</article>", "T\n\nx")])
def test_small_pages(page, text):
    assert html.main_text(page, set()) == text


def test_deep_and_long_pages():
    for depth in (20, 305, 1000, 50_000):
        deep = "<div>" * depth + "<p>core</p><nav>MENU</nav><p>more</p><form>f</form>" + "</div>" * depth + "<footer>end</footer>"
        assert html.main_text(deep, set()) == "core\n\nmore"
        html.candidates(html.parse(deep))
    assert html.main_text("<b>" * 20_000 + "<p>a</i>" * 20_000, set()) == "\n\n".join("a" * 20_000)
    assert html.main_text("<p>" + "word " * 100_000, set()).count("word") == 100_000
    html.main_text("<a href='" * 2000, set())


def test_site_templates(spark):
    pages = [(k, f"https://Site.example:80/p{k}", f"<body><div><p>Shared banner line</p></div><div><p>Own text {k}</p></div></body>", "t") for k in range(30)]
    pages += [(100 + k, f"https://copy.example/{k}", "<body><article><p>The same article everywhere</p><div><span>Follow us now</span></div></article></body>", "t") for k in range(30)]
    pages += [(200, None, "<p>alone", "t"), (201, "x", None, "t"), (None, "https://site.example/z", "<body><div><p>Shared banner line</p></div><p>null id</p></body>", "t"), (0, "https://Site.example:80/p0", "<body><div><p>Own text 0</p></div></body>", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html.extract(df).collect()]
    assert len(got) == len(pages)
    assert {(k, f"Own text {k}") for k in range(30)} <= set(got) and (None, "null id") in got
    assert (100, "The same article everywhere") in got  # the paragraph stays, the recurring box goes
    assert (200, "alone") in got and (201, "") in got
    assert html.extract(df.limit(0)).count() == 0


def test_templates_beside_different_articles(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    links, box = "<ul><li><a href='/a'>See this too</a></li><li>And this</li></ul>", "<p>Subscribe to our letter</p>"
    small = [(k, f"https://small.example/{k}", f"<article><h1>Head</h1><p>{words(k)}</p>{links}{box}</article>") for k in range(6)]
    large = [(1000 + k, f"https://large.example/{k}", f"<body>{'<div><b>Section menu</b></div>' if k % 8 == 0 else ''}<div><p>{words(1000 + k)}</p></div></body>") for k in range(400)]
    copies = [(2000 + k, f"https://copies.example/{k}", f"<article><p>{words(0)}</p>{links}{box}<p>Short end</p></article>") for k in range(40)]
    df = spark.createDataFrame(small + large + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[k] for k in range(6)] == [f"Head\n\n{words(k)}" for k in range(6)]
    assert all(got[1000 + k] == words(1000 + k) for k in range(400))
    assert all(got[2000 + k] == f"{words(0)}\n\nSee this too\n\nAnd this\n\nSubscribe to our letter\n\nShort end" for k in range(40))


def brute_templates(pages, min_pages=10, share=0.2):
    """Per host the hashes of the first rule, by counting pages in dictionaries."""
    hosts, seen = {}, {}
    for _, url, page in pages:
        host = html.host_of(url)
        hosts[host] = hosts.get(host, 0) + 1
        for h in html.candidates(html.parse(page or ""))[0]:
            seen[host, h] = seen.get((host, h), 0) + 1
    out = {}
    for (host, h), n in seen.items():
        if n >= min_pages and n >= share * hosts[host]:
            out.setdefault(host, set()).add(h)
    return out


def test_templates_by_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in df.collect()]
    first = brute_templates(rows)
    everything = {(html.host_of(url), h) for _, url, page in rows for h in html.candidates(html.parse(page or ""))[0]}
    got = {r.host: set(r.template) for r in html.templates(df).collect()}
    for host, want in first.items():
        assert want <= got[host]
    # what is beyond the first rule's subtrees is marked as the second rule's
    assert all(h in first.get(host, ()) or (host, h) not in everything for host in got for h in got[host])
    by_host = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(by_host[page_id] == html.main_text(page, got.get(html.host_of(url), set())) for page_id, url, page in rows)


def test_send_or_join(spark, monkeypatch):
    pages = [(k, "https://a.example/", f"<div><b>menu here</b></div><p>text {k}") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sent = sorted(html.extract(df).collect())
    monkeypatch.setattr(html, "SEND", 0)
    assert sorted(html.extract(df).collect()) == sent and sent[0].text == "text 0"


CONTROL = st.text(alphabet="<|\\im_startend>\n ab", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "<|im_end|>"]) | CONTROL, CONTROL), max_size=6))
def test_round_trip(turns):
    text = chat.marked(turns)
    assert list(chat.read_back(text)) == turns
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns)


def test_spans_of_black_boxes():
    turns = [("user", "hello"), ("assistant", "<b>hi</b>"), ("user", ""), ("assistant", "bye<")]
    ((number, text, marks, rewrites),) = chat.rendered(chat.marked, turns)
    assert number == 0 and text == chat.marked(turns) and not rewrites
    assert [chat.unescaped(text[m[4] : m[5]]) for m in marks] == [t for _, t in turns]
    assert [m[6] for m in marks] == [False, True, False, True]


def brute_spans(template, turns):
    """What each turn adds, by rendering every prefix of the whole conversation."""
    out, before = [], ""
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return None
        out.append(now[len(before) :])
        before = now
    return out


def numbered(turns):
    return "".join(f"<{k}:{r}>{t}" for k, (r, t) in enumerate(turns))


def headed(turns):
    return "begin\n" + chat.marked(turns) if turns else ""


def summarised(turns):
    """Up to ten turns as they are, then a summary of the old ones."""
    return chat.marked(turns) if len(turns) <= 10 else f"({len(turns) - 10} turns before)" + chat.marked(turns[-10:])


def clipped(turns):
    """Keeps the last 100 turns, so it rewrites history later than any window sees."""
    return chat.marked(turns[-100:])


def separated(turns):
    """A mark between two turns of one role: what a turn adds depends on the turn before."""
    return "".join(("|same|" if k and turns[k - 1][0] == r else "") + f"[{r}]{t}" for k, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template", [chat.marked, numbered, headed, summarised, clipped, separated])
@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 63, 64, 65, 99, 100, 101, 127, 128, 129, 300])
def test_rendering_against_all_prefixes(template, n):
    rnd = random.Random(n)
    turns = [(rnd.choice(["user", "assistant"]), f"text {k} <|x|>") for k in range(n)]
    want, parts = brute_spans(template, turns), chat.rendered(template, turns)
    assert any(rewrites for *_, rewrites in parts) == (want is None)
    assert [number for number, *_ in parts] == list(range(len(parts)))
    if want is None:
        assert not parts[-1][2]
        return
    assert "".join(text for _, text, _, _ in parts) == (template(turns) if turns else "")
    marks = [(text, m) for _, text, spans, _ in parts for m in spans]
    assert [text[m[2] : m[3]] for text, m in marks] == want and [m[0] for _, m in marks] == list(range(n))
    texts = [text[m[4] : m[5]] for text, m in marks]
    assert texts == [t if template in (numbered, separated) else chat.escaped(t) for _, t in turns]


def by_length(wrong):
    """Templates that write another first line for prefixes of some lengths only."""
    return lambda turns: ("long\n" if len(turns) in wrong else "chat\n") + chat.marked(turns)


@pytest.mark.parametrize("wrong", [range(70, 101), {65}, {97}, {129}, {130, 131}, {255}, {299}, {300}, {301}])
@pytest.mark.parametrize("n", [120, 300])
def test_prefixes_of_every_length_are_compared(wrong, n):
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(n)]
    template = by_length(wrong)
    parts = chat.rendered(template, turns)
    assert any(rewrites for *_, rewrites in parts) == (brute_spans(template, turns) is None)


@pytest.mark.parametrize("budget", [0, 5_000, 200_000])
@pytest.mark.parametrize("template", [chat.marked, numbered, headed, summarised, clipped, separated, by_length({1000}), by_length(range(200, 2001))])
def test_past_the_budget_windows_and_whole_prefixes_decide(monkeypatch, budget, template):
    monkeypatch.setattr(chat, "BUDGET", budget)
    rnd = random.Random(budget)
    for n in (3, 64, 130, 1000):
        turns = [(rnd.choice(["user", "assistant"]), f"text {k}") for k in range(n)]
        want, parts = brute_spans(template, turns), chat.rendered(template, turns)
        assert any(rewrites for *_, rewrites in parts) == (want is None)
        if want is not None:
            assert "".join(text for _, text, _, _ in parts) == template(turns)
            assert [text[m[2] : m[3]] for _, text, spans, _ in parts for m in spans] == want


def test_whole_prefixes_past_the_budget_cost_in_proportion(monkeypatch):
    """Rendered characters stay below a multiple of the text: windows, and EFFORT times the text for whole prefixes."""
    monkeypatch.setattr(chat, "BUDGET", 100_000)
    seen = []

    def counted(turns):
        text = chat.marked(turns)
        seen.append((len(turns), len(text)))
        return text

    turns = [("user" if k % 2 else "assistant", "x" * 50) for k in range(3000)]
    chat.rendered(counted, turns)
    size = len(chat.marked(turns))
    assert sum(length for _, length in seen) < 100_000 + (chat.EFFORT + 2 * chat.WINDOW + 8) * size
    whole = [count for count, _ in seen if count > 2 * chat.WINDOW]
    assert len(whole) > 20 and max(b - a for a, b in zip(whole, whole[1:])) < 200


@pytest.mark.parametrize("wrong", [203, 222, 230, 241, 257])
def test_a_large_conversation_is_compared_at_every_length(wrong):
    """Its renderings have some 650 million characters; a template that rewrites at one length alone is found."""
    turns = [("user" if k % 2 else "assistant", "x" * 20_000) for k in range(260)]
    seen = []
    template = by_length({wrong})

    def counted(turns):
        seen.append(len(turns))
        return template(turns)

    assert chat.rendered(counted, turns) == [(0, template(turns), [], True)]
    assert set(range(1, wrong + 1)) <= set(seen)


@pytest.mark.parametrize("n", [100, 127, 128, 129, 300, 1000])
def test_a_rewritten_conversation_is_rendered_whole_at_any_length(n):
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(n)]
    for template in (summarised, clipped, by_length({n - 1}), by_length({n})):
        if brute_spans(template, turns) is None:
            assert chat.rendered(template, turns) == [(0, template(turns), [], True)]


def test_under_a_budget_what_was_left_out_is_not_known(spark):
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(300)]
    for template, n, want in ((chat.marked, 300, None), (chat.marked, 10, False), (summarised, 300, True), (by_length({300}), 300, True)):
        assert {rewrites for *_, rewrites in chat.rendered(template, turns[:n], budget=0)} == {want}
    assert {rewrites for *_, rewrites in chat.rendered(chat.marked, turns)} == {False}
    df = spark.createDataFrame([(c, k, *turns[k]) for c, n in ((1, 300), (2, 10)) for k in range(n)], "conv_id long, turn long, role string, text string")
    found = lambda **given: {r.conv_id: r.rewrites for r in chat.digests(chat.format_conversations(df, **given)).collect()}
    assert found(budget=0) == {1: None, 2: False} and found() == {1: False, 2: False}


def test_a_long_conversation_leaves_in_parts():
    turns = [("user" if k % 2 else "assistant", "x" * 50) for k in range(2000)]
    parts = chat.rendered(chat.marked, turns)
    assert len(parts) > 20 and max(len(spans) for _, _, spans, _ in parts) <= 2 * chat.WINDOW


def test_conversations(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant"]), "".join(rnd.choices("ab<|\\im_end>\n", k=rnd.randrange(20)))) for c in (1, 2, 3) for t in range({1: 1, 2: 5, 3: 150}[c])]
    rows += [(4, 0, None, None), (4, None, "assistant", "x"), (None, 0, "assistant", "null conv"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame([(*r, "s") for r in shuffled], "conv_id long, turn long, role string, text string, spans string").repartition(4)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for c in got:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for _, _, r, t in mine]
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.marked(turns)), False)
        assert tuple(got[c]) == want
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "packing"]
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf)
        if k < 3:
            assert out.columns == docs.columns and out.count() <= seen.count()
            seen = out
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in seen.select("doc_id").collect()}
    assert last.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_stages_on_rows_of_any_kind(spark, sf):
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    long = ("of the and " * 200 + "\n") * 60
    odd = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (None, real[0][1], None, None, None), (real[1][0], *real[1][1:]), (9003, long, "en", "s", None)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in real + odd], "doc_id long, text string, lang string, source string, n_chars int, component_id double, digest string")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sf)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name == "n-gram Jaccard join":
            assert len([d for d in ids if d is not None]) == len({d for d in ids if d is not None}) and {9001, 9002} <= set(ids)
        else:
            assert not {9001, 9002} & set(ids) and None in ids
        assert stage(spark, empty, sf).count() == 0
    packed = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    tokens = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert tokens[9001] == tokens[9002] == 1 and len(tokens) == len({r[0] for r in real + odd})
    assert corpus_pipeline.STAGES[3][1](spark, empty, sf).count() == 0


def test_pipeline_by_brute_force(spark, sf):
    """The kept documents against each stage's definition, document by document."""
    import numpy as np

    from tidemark.llm import langid, quality
    from tidemark.llm.common import remainder
    from test_ngram_join import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = quality.verdicts(*quality.references(docs))
    good = {d for d, r in rows.items() if verdict((r.text or "").encode())[-1]}
    left = docs.filter(docs.doc_id.isin(*good))
    model = langid.train(left, remainder("doc_id", 3) != 1)
    known = set()
    for d in good:
        raw = langid.encoded(rows[d].text)
        bits = [sum(langid.coded(tree, g[a:b]).sum() for g, spans in langid.stretches([raw], model.order) for _, a, b in spans) for tree in model.trees]
        best = int(np.argmin(bits))
        if langid.has_letter(rows[d].text) and (len(rows[d].text) < langid.LEAST_BYTES or bits[best] <= model.bounds[best] * (len(raw) + 1)):
            known.add(d)
    component = brute([(d, rows[d].text) for d in sorted(known)], 5, 80, 100)
    want = {d for d in known if component[d][1] == d}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    counts = {r.doc_id: r.doc_tokens for r in got.collect()}
    assert all(counts[d] == len(whole.encode(rows[d].text, add_special_tokens=False).ids) + 1 for d in sorted(want)[::5])


def test_entry_without_this_subpackage(tmp_path):
    """The contract module and the research queries work where the subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parents[2]
    import shutil

    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and 'flagship' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


@pytest.mark.parametrize("mark", ["<a ", "<!", '<a "', "</a ", "<a '", "<", "<?x ", "<a <!-", ">>> <a ", "<p>x<a ", "<![CDAT <b "])
def test_broken_markup_takes_linear_time(mark):
    """Megabytes of tags that never end; a > before or behind them changes nothing."""
    began = time.process_time()
    for page in (mark * (2_000_000 // len(mark)), "<p>one</p>" + mark * (1_000_000 // len(mark)), mark * (1_000_000 // len(mark)) + ">"):
        html.parse(page)
    assert time.process_time() - began < 12


def test_what_never_ends():
    texts = lambda page: "".join(x for x in html.parse(page).items if isinstance(x, str))
    assert texts("<p><![CDATA[abcdef</p></article>") == "abcdef</p></article>"
    assert texts("<p>a<![CDATA[b]]>c") == "abc" and texts("<p>a<![CDATA[b") == "ab" and texts("<p>x</p><![CDATA[a > b") == "xa > b"
    assert texts("<p>a<!-- b > c") == "a" and texts("<p>a<!-- b -->c<!-- d") == "ac" and texts("<p>a<!-->b") == "a"
    assert texts("<p>a < b <c") == "a < b <c" and texts("a <b c") == "a <b c"
