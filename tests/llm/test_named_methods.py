"""Steps of the named methods that must have an effect: chunks of lines in the pipeline, a host's template on pages with an article."""

import random
from hashlib import md5

import corpus_pipeline
from graphloom.llm import html_template, line_chunks
from graphloom.llm.store import Scratch


def chunk_spans(lines):
    """(start, end) of the chunks, as operator 5 cuts them."""
    hashes = [int(md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    start = 0
    for i in range(len(lines)):
        rolled = sum(h * f for h, f in zip([hashes[i], *reversed(hashes[max(0, i - 2) : i])], (1, 31, 961), strict=False))
        if i == len(lines) - 1 or rolled % 4 == 0:
            yield start, i
            start = i + 1


def without(given, chunks=True):
    """Texts less the chunks and pairs of lines that stand at an earlier place of the given texts, and the numbers of all pairs and of those outside these chunks."""
    seen, out, n, outside = set(), {}, 0, 0
    for i, text in sorted(given.items()):
        lines, gone = text.split("\n"), set()
        solid = [k for k, line in enumerate(lines) if line.strip()]
        spans = [(True, a, b) for a, b in chunk_spans(lines) if sum(a <= k <= b for k in solid) >= 2] if chunks else []
        spans += [(False, a, b) for a, b in zip(solid, solid[1:], strict=False)]
        late = []
        for wide, a, b in spans:
            body = (wide, "\n".join(lines[a : b + 1]))
            if body in seen:
                gone |= set(range(a, b + 1))
                late += [(a, b)] * wide
            seen.add(body)
            n += not wide
            outside += not wide and not any(c <= a and b <= d for c, d in late)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text
    return out, n, outside


def test_line_stage_removes_chunks_and_then_pairs(spark, monkeypatch):
    rng, counts, write = random.Random(4), {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    shared = [[rng.choice(["", " ", *(f"line {k} {j}" for j in range(30))]) for _ in range(rng.randint(2, 30))] for k in range(6)]
    given = {}
    for i in range(50):
        parts = [[f"own {i} {j}"] + rng.choice(shared)[rng.randint(0, 3) :] for j in range(rng.randint(1, 3))]
        given[i] = "\n".join(line for part in parts for line in [*part, *[""] * rng.randint(0, 2)])
    given[50] = given[7]
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    want, n, outside = without(given)
    monkeypatch.setattr(Scratch, "write", counted)
    assert {r.doc_id: r.text for r in line_chunks.dedup_passages(docs).collect()} == want
    # Blank lines at a chunk's ends go with it, and pairs inside a removed chunk aren't compared again.
    assert want != without(given, chunks=False)[0] and counts["pairs"] == outside < n
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {i: t for i, t in want.items() if t.strip()}


def test_template_tells_teasers_from_articles(spark):
    """Article elements that hold links alone on every page of the host go; the same page keeps them where the host's other pages have text there."""
    card = lambda i, inside: f"<div class='x'><article><p>{inside}</p></article></div>"
    body = lambda i, inside: f"<article><h1><a href='/{i}'>Title {i}</a></h1><div>Text {i}</div><article><i><a href='/n'>Nested {i}</a></i></article></article>{card(i, inside)}"
    link = lambda i: f"<a href='/{i}'>Card {i}</a>"
    rows = [(i, f"http://links.org/{i}", body(i, link(i))) for i in range(6)]
    rows += [(10 + i, f"http://words.org/{i}", body(i, link(i) if i < 4 else f"Said {i}")) for i in range(6)]
    rows += [(20 + i, f"http://few.org/{i}", body(i, link(i))) for i in range(2)]
    rows += [(30 + i, f"http://index.org/{i}", f"<article>{link(i)}</article>") for i in range(6)]
    got = {r.page_id: r.text for r in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Title {i}\nText {i}" for i in range(6)}
    want |= {10 + i: f"Title {i}\nText {i}\n" + (f"Card {i}" if i < 4 else f"Said {i}") for i in range(6)}
    want |= {20 + i: f"Title {i}\nText {i}\nNested {i}\nCard {i}" for i in range(2)}
    want |= {30 + i: f"Card {i}" for i in range(6)}
    assert got == want
