import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions.markup import pieces
from docloom.llm import main_body, residue
from docloom.llm.wrapper import Node, dump, grouped, load

SCHEMA = "fetch_id long, page_url string, page_html string, export_view_html string"


def sentence(r):
    return f"The {r.choice('abcdefgh')}{r.randrange(99999)} service reads the {r.choice('stuvw')}{r.randrange(99999)} key and waits for {r.randrange(999)} seconds before the next request."


def site(host, count, seed):
    """Pages of one layout with the texts of their main bodies."""
    r = random.Random(seed)
    teaser = sentence(r)
    out = []
    for i in range(count):
        paragraphs = [sentence(r) for _ in range(r.randrange(3, 9))]
        body = f"<h1>Title {i}</h1>" + "".join(f"<p>{p}</p>" + ("<div class=toc><a href=#x>Title</a><a href=#y>Next</a></div>" if k == 1 and r.random() < 0.5 else "") for k, p in enumerate(paragraphs))
        note = sentence(r) + " Note it."
        body += f"<div role=note><p>{note}</p></div><ul><li>{paragraphs[0]} again<li>more {i} text</ul>"
        html = f"<html><head><title>x</title></head><body><nav><a href=/a>Home</a><a href=/b>Search</a></nav><div class=c1>{body}</div><div class=c2><ul><li><a href=/q>Related {r.randrange(50)}</a></li></ul><p>{teaser}</p></div><footer><p>Imprint</p></footer></body></html>"
        out.append((host, f"https://{host}/p{i}", html, {f"Title {i}", *paragraphs, note, f"{paragraphs[0]} again", f"more {i} text"}))
    return out


def table(spark, extra=()):
    made = site("a.example", 14, 1) + site("b.example", 10, 2)
    rows = [(i, url, html, None) for i, (_, url, html, _) in enumerate(made)]
    return made, rows, spark.createDataFrame([*rows, *extra, rows[0]], SCHEMA)


CASES = ["<h1>T</h1><p>[Add your overview]</p><td>{{ page.body }}</td>", "<div>You need to enable JavaScript to run this app.</div>", "<h1>Page not found</h1><p>The page you asked for does not exist or was moved.</p>", "<h1>X</h1><p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>"]


def test_main_bodies(spark):
    made, rows, df = table(spark, [(900 + i, "https://a.example/case", html, None) for i, html in enumerate(CASES)] + [(990, None, None, ""), (991, "x", "", None), (992, None, "<p></p>", None)])
    got = {}
    for r in residue.main_pieces(df).collect():
        got.setdefault(r["fetch_id"], set()).add(r["piece_no"])
    right = wrong = missed = 0
    for i, (_, _, html, body) in enumerate(made):
        for p in pieces(html):
            main, said = p.text.strip() in body, p.number in got.get(i, set())
            right, wrong, missed = right + (main and said), wrong + (said and not main), missed + (main and not said)
    assert right > 200 and wrong <= 0.02 * right and missed <= 0.02 * right
    assert not {900, 901, 902, 903, 990, 991, 992} & set(got)


def test_residue(spark):
    made, rows, df = table(spark, [(900 + i, "https://a.example/case", html, None) for i, html in enumerate(CASES)] + [(950, "https://a.example/q", f"<h1>Q</h1><p>{sentence(random.Random(9))}</p><p>[Add your overview]</p>", None)])
    assert {r["fetch_id"] for r in residue.residue_fetches(df).collect()} == {900, 901, 902, 903}
    assert residue.without_residue(df).count() == len(rows) + 1


def test_coverage():
    judge = residue.Judge([sentence(random.Random(i)) for i in range(400)])
    assert judge.coverage("TODO: describe scope") > 0.9 and judge.coverage(sentence(random.Random(999))) < 0.1 and judge.coverage("") == 0.0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert residue.main_pieces(df).count() == 0 and residue.residue_fetches(df).count() == 0


def page_of(*names):
    return Node("", inner=grouped([Node(n) for n in names]))


def test_wrappers():
    whole = page_of("nav", "body", "toc", "footer")
    whole.absorb(page_of("body", "share", "share", "footer"), False)
    whole.absorb(page_of("nav", "body", "footer"), False)
    assert [(n.name, n.pages) for n in whole.inner] == [("nav", 2), ("body", 3), ("toc", 1), ("share", 1), ("footer", 3)]
    assert whole.inner[3].repeated == 1 and whole.inner[1].repeated == 0
    assert dump(load(dump(whole))) == dump(whole)
    assert [n.name for n in grouped([Node(x) for x in "ababac"])] == ["a", "b", "a", "c"]
    assert main_body.hashed("Edited 3 days  ago") == main_body.hashed("edited 12 days ago")


def test_names_made_up_for_each_page_are_generalised():
    whole = page_of("body")
    for i in range(400):
        whole.absorb(page_of(f"div[class=x{i}]", "body", f"p[id={i}]"), False)
    assert len(whole.inner) <= 121 and next(n for n in whole.inner if n.name == "body").pages == 401
    assert sum(n.pages for n in whole.inner if n.name != "body") + sum(n.pages for n in whole.other.values()) == 800


def read(spark, rows):
    """Texts of the main bodies of pages (url, html), by page."""
    df = spark.createDataFrame([(i, url, html, None) for i, (url, html) in enumerate(rows)], SCHEMA)
    out = [set() for _ in rows]
    for r in residue.main_pieces(df).collect():
        out[r["fetch_id"]].add(next(p.text for p in pieces(rows[r["fetch_id"]][1]) if p.number == r["piece_no"]))
    return out


def test_a_site_without_first_headings(spark):
    r = random.Random(3)
    bodies = [[sentence(r) for _ in range(4)] for _ in range(9)]
    rows = [(f"https://n.example/{i}", f"<div class=m><a href=/a>Home</a><a href=/b>About us</a></div><div class=t>{''.join(f'<p>{s}</p>' for s in own)}</div><div class=f><p>All of this was made by the same people who made the other guides.</p></div>") for i, own in enumerate(bodies)]
    assert read(spark, rows) == [set(own) for own in bodies]


def test_the_sites_name_as_first_heading(spark):
    r = random.Random(4)
    bodies = [[sentence(r) for _ in range(4)] for _ in range(9)]
    rows = [(f"https://s.example/{i}", f"<div class=top><h1>Guides of the house</h1></div><div class=t><h2>Part {i}</h2>{''.join(f'<p>{s}</p>' for s in own)}</div><div class=f><p>Imprint</p></div>") for i, own in enumerate(bodies)]
    assert read(spark, rows) == [{f"Part {i}", *own} for i, own in enumerate(bodies)]


def test_a_title_in_a_container_of_its_own(spark):
    r = random.Random(5)
    bodies = [[sentence(r) for _ in range(4)] for _ in range(9)]
    rows = [(f"https://o.example/{i}", f"<div class=head><h1>Title {i}</h1></div><div class=t>{''.join(f'<p>{s}</p>' for s in own)}</div><div class=f><p>Imprint</p></div>") for i, own in enumerate(bodies)]
    assert read(spark, rows) == [{f"Title {i}", *own} for i, own in enumerate(bodies)]


def test_another_container_per_layout(spark):
    r = random.Random(6)
    bodies = [[sentence(r) for _ in range(4)] for _ in range(12)]
    layout = lambda i: ("article", "div class=main", "section id=text")[i % 3]
    rows = [(f"https://l.example/{i}", f"<nav><a href=/a>Home</a></nav><{layout(i)}>{f'<h1>T {i}</h1>' if i % 2 else ''}{''.join(f'<p>{s}</p>' for s in own)}</{layout(i).split()[0]}><footer><p>Imprint</p></footer>") for i, own in enumerate(bodies)]
    assert read(spark, rows) == [set(own) | ({f"T {i}"} if i % 2 else set()) for i, own in enumerate(bodies)]


def test_places_not_names_tell_what_is_text(spark):
    """Boxes of one name stand before the body's text, with recurring matter, and after it, with text: sums by name would take both."""
    r = random.Random(7)
    offers = [f"{sentence(r)} Order now." for _ in range(2)]
    bodies = [[sentence(r) for _ in range(4)] for _ in range(10)]
    notes = [sentence(r) for _ in bodies]
    rows = [
        (f"https://b.example/{i}", f"<main><h1>T {i}</h1><div class=box><p>{offers[i % 2]}</p></div><p>{own[0]}</p><div class=wrap>{''.join(f'<p>{s}</p>' for s in own[1:])}</div><div class=box><p>{notes[i]}</p></div></main><footer><p>Imprint</p></footer>")
        for i, own in enumerate(bodies)
    ]
    assert read(spark, rows) == [{f"T {i}", *own, notes[i]} for i, own in enumerate(bodies)]
    whole = None
    for _, html in rows:
        own = main_body.Page(main_body.units_of(html)).sums().wrapper()
        whole = own if whole is None else whole
        if own is not whole:
            whole.absorb(own, False)
    before, _, after = whole.inner[0].inner
    assert before.name == after.name and after.is_text() and not before.is_text()
    before.absorb(after, False)
    assert before.is_text()


#: Wordings that no model is fitted on, by kind.
HELD_OUT = {
    "errors": ["This document isn't available any more. It was deleted by its owner.", "We're sorry, the requested file does not exist on this server.", "The server failed to process the request. Please retry in a few minutes.", "Bad gateway: the proxy received an invalid response from an upstream server.", "Access is restricted. Please ask an administrator for permission to view the page.", "Your session is no longer valid. Sign in again.", "Too many attempts from your address. Please wait and try once more.", "The portal is down for planned maintenance. Please come back in an hour.", "Esta página no se encuentra disponible. Compruebe que la dirección es correcta.", "Se ha producido un problema en el servidor. Vuelva a intentarlo más tarde.", "Diese Seite existiert nicht mehr oder wurde gelöscht. Prüfen Sie die Adresse.", "Der Server ist zurzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "A página que procura já não existe ou foi removida.", "Não tem permissão para aceder a este conteúdo. Fale com o administrador."],
    "scripts": ["You must turn on JavaScript in your browser to see the content of this page.", "Scripts are disabled. Enable scripts and reload.", "This website relies on JavaScript. Please activate it and refresh.", "Active JavaScript en su navegador para ver el contenido.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Para ver esta página, ligue o JavaScript no seu navegador.", "The page is loading, please wait. If it does not appear, enable scripts."],
    "filler": ["Lorem ipsum dolor sit amet, sed ultricies urna porta at felis.", "Vestibulum ante orci luctus et ultrices posuere cubilia.", "Your text goes here.", "This is placeholder text, to be replaced before publishing.", "asdf asdf asdfgh", "Este texto es provisional, reemplace el contenido.", "Hier steht bald Ihr Text.", "Texto de amostra, troque este conteúdo."],
    "templates": ["{{ owner.name }}", "${release_date}", "%%DOC_VERSION%%", "[Insert the summary here]", "TODO: add summary", "<your description>", "[[ page_title ]]", "Enter the summary in this field", "[Indique aquí el resumen]"],
}


def test_wordings_kept_out_of_the_fit():
    prose = [sentence(random.Random(i)) for i in range(600)]
    judge = residue.Judge(prose)
    fit = " ".join((residue.ERRORS, residue.SCRIPTS, residue.FILLER)).lower()
    for kind, texts in HELD_OUT.items():
        assert not [t for t in texts if t.lower() in fit]
        found = [t for t in texts if judge.is_residue(t)]
        assert len(found) >= 0.9 * len(texts), (kind, set(texts) - set(found))
    assert not [t for t in (sentence(random.Random(5000 + i)) for i in range(200)) if judge.is_residue(t)]


def test_models_learn_from_the_corpus():
    prose = [sentence(random.Random(i)) for i in range(600)]
    odd = "Quorvex lumbered: the page wandered off the shelf, sorry."
    short = ["Sorry, this page cannot be found. Quorvex lumbered off the shelf.", "Quorvex lumbered: the page could not be found, sorry."] * 4
    assert residue.Judge(prose, short=short).coverage(odd) > residue.Judge(prose).coverage(odd)


def test_shared_constants_recur_on_several_hosts(spark):
    rows = [(f"h{h}", 0, 0, page) for h in range(4) for page in range(60)]
    rows += [(f"h{h}", 4, 1, h) for h in range(3)]  # once on each of three hosts: text
    rows += [(f"h{h}", 4, 2, page) for h in range(3) for page in range(2)] + [("h3", 4, 2, 7)]  # recurs on three hosts
    rows += [(f"h{h}", 4, 3, page) for h in range(2) for page in range(4)] + [("h2", 4, 3, 1)]  # on two only
    rows += [("big" + str(h), 0, 0, page) for h in range(3) for page in range(300)]
    rows += [("big" + str(h), 4, 4, page) for h in range(3) for page in range(2)]  # twice in 300 pages
    surveyed = spark.createDataFrame([(r[0], "page_html", *r[1:], "short" if r[3] == 1 else "long") for r in rows], "host string, field string, kind int, key long, page long, wrapper string")
    assert {(r["host"], r["key"]) for r in main_body.constants(surveyed).collect()} == {(f"h{h}", 2) for h in range(4)}
    assert {r["furniture"] for r in main_body.constants(surveyed).collect()} == {False}  # as many short bodies have it as long ones
    long = surveyed.withColumn("wrapper", F.when(F.col("wrapper").isNotNull(), "long"))
    assert {r["furniture"] for r in main_body.constants(long).collect()} == {True}


def test_wrappers_joined_where_they_are_too_many_to_send(spark, monkeypatch):
    _, _, df = table(spark)
    sent = {tuple(r) for r in residue.main_pieces(df).collect()}
    monkeypatch.setattr(main_body, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in residue.main_pieces(df).collect()} == sent and sent


def test_models_are_fitted_on_every_block(spark):
    """More blocks than any sample held: the models are those of all of them, each once."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    bodies = [[f"The {word()} service reads the {word()} key and waits for {r.randrange(99)} seconds." for _ in range(80)] for _ in range(40)]
    rows = [(i, f"https://m.example/{i}", f"<main><h1>T {i}</h1>{''.join(f'<p>{s}</p>' for s in own)}</main><footer><p>Made {i} by hand</p></footer>", None) for i, own in enumerate(bodies)]
    rows += [(100 + i, f"https://m.example/s{i}", f"<main><h1>S {i}</h1><p>Sorry, this page cannot be found. Quorvex {'abcdefgh'[i]} lumbered.</p></main>", None) for i in range(8)]
    _, surveyed = main_body.survey(spark.createDataFrame([*rows, *rows], SCHEMA).repartition(7))
    texts = [s for own in bodies for s in own]
    counts = residue.tallied(texts)
    assert (counts == sum(np.bincount(residue.slots(s), minlength=residue.SLOTS) for s in texts)).all()
    judge = residue.judge_of(surveyed)
    distinct = {main_body.plain(s) for s in texts}
    short = [f"Sorry, this page cannot be found. Quorvex {c} lumbered." for c in "abcdefgh"]
    assert len(distinct) > 3000 and (judge.models == residue.Judge(distinct, ["Made 0 by hand"], short).models).all()
    assert not (judge.models == residue.Judge(distinct, ["Made 0 by hand"]).models).all()  # the short ones were learned from


def test_recurring_texts_are_counted_over_all_pages(spark):
    """A text on every page beside one that varies: half of the texts come again, which no few of them can tell."""
    html = [f"<main><h1>T {i}</h1><div class=box><p>The same on every page of the site.</p><p>{i:04d} is the number of no other page: {'abcdefgh'[i % 8] * (i + 9)}</p></div></main>" for i in range(60)]
    df = spark.createDataFrame([(i, f"https://r.example/{i}", own, None) for i, own in enumerate(html)], SCHEMA).repartition(6)
    _, surveyed = main_body.survey(df)
    (found,) = main_body.wrappers(surveyed).collect()
    box = next(n for n in load(found["wrapper"]).nodes() if n.name == "div[class=box]")
    assert (box.pages, box.held, box.again, box.recurring()) == (60, 120, 60, 0.5)
    alone = Node("")
    alone.texts = {1: 40} | {k: 1 for k in range(2, 42)}
    assert alone.recurring() == 0.5


def test_texts_handed_over_early_stay_with_their_nodes(monkeypatch):
    monkeypatch.setattr(main_body, "TEXTS_AT_ONCE", 5)
    task = main_body.Survey(iter(range(100)))
    html = [f"<main><h1>T {i}</h1><p>Always.</p></main><footer><p>Imprint {i}</p></footer>" for i in range(8)]
    batches = [pa.RecordBatch.from_pydict({"host": ["h"] * 4, "page": list(range(4)), "page_html": html[k : k + 4]}) for k in (0, 4)]
    rows = [r for out in (*map(task.read, batches), task.rest()) for r in out.to_pylist()]
    texts = [r for r in rows if r["kind"] == 5]
    assert len(texts) == 4 and len({r["key"] for r in texts}) == 2 and sum(sum(r["counts"]) for r in texts) == 24
    (whole,) = [load(r["wrapper"]) for r in rows if r["kind"] == 2]
    assert sorted(n.numbers for n in whole.nodes() if n.numbers) == sorted([r] for r in {r["key"] for r in texts})
