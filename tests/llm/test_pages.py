"""Near-duplicates, main bodies and residue on small made-up sites."""

import datetime as dt
import json
import random

import numpy as np

from auditloom.llm import mainbody, neardup
from auditloom.llm.html import page_html, visible_words
from auditloom.llm.mainbody import body_spans, main_blocks, page_lines
from auditloom.llm.neardup import candidates, cells, page_cells, page_classes, page_pairs, top, word_runs
from auditloom.llm.residue import grams, has_placeholder, propagate, residue_pages, simhashes, trusted_label, unit_wording

T = dt.datetime(2025, 1, 1)
KIND = "url string, html_blob binary, analysed_at timestamp, sid string, host string, reason string"


def blob(html):
    return bytearray(json.dumps({"html": html, "encoding": "utf-8"}).encode())


def cache(spark, pages):
    """Rows of a cache with broken, repeated, old and null ones around the given pages, and clashing extra columns."""
    rows = [(u, blob(h), T, "s", "h", "r") for u, h in pages]
    rows += rows[:2] + [(u, blob("<p>old</p>"), T - dt.timedelta(days=1), "s", "h", "r") for u, _ in pages[:3]]
    rows += [("https://broken.example/1", bytearray(b'{"html": "<p>cut'), T, "", "", ""), ("https://null.example/1", None, T, "", "", ""), (None, blob("<p>x</p>"), T, "", "", ""),
             ("https://empty.example/1", blob(""), T, "", "", ""), ("https://list.example/1", bytearray(b"[1]"), T, "", "", ""), ("https://gone.example/1", blob("<p>was here</p>"), T - dt.timedelta(days=1), "", "", ""), ("https://gone.example/1", None, T, "", "", "")]
    return spark.createDataFrame(rows, KIND)


def test_words():
    html = "<title>A&amp;B</title><!-- no --><script>no</script><noscript>no</noscript><p>One<b>Two</b>&nbsp;THREE <% x %></p><style>no"
    assert visible_words(html) == ["a&b", "one", "two", "three", "<%", "x", "%>"]
    assert len(word_runs(["a"] * 4)) == 0 and len(word_runs(["a"] * 9)) == 1 and page_html(None) is None and page_html(b"{") is None


def brute(pages):
    sets = {u: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for u, h in pages for w in [visible_words(h)]}
    urls = sorted(u for u in sets if sets[u])
    return {(a, b) for i, a in enumerate(urls) for b in urls[i + 1 :] if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}


def near_corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    pages = []
    for site in range(3):
        frame = " ".join(rng.choices(words, k=30))
        for i in range(40 if site else 60):
            body = rng.choices(words, k=rng.choice([6, 20, 90, 300]))
            if i % 3 == 0 and i:
                body = last[:]
                for _ in range(rng.choice([0, 1, 2, 5, 9])):
                    body[rng.randrange(len(body))] = "edit"
            last = body
            pages.append((f"https://s{site}.example/{i}", f"<p>{frame}</p><p>{' '.join(body)}</p>"))
        pages += [(f"https://s{site}.example/copy{i}", f"<div>{frame} same text of an error page</div>") for i in range(25)]
    return pages


def test_near_pairs_lose_nothing(spark):
    pages = near_corpus()
    got = [tuple(r) for r in page_pairs(cache(spark, pages)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pages)
    assert page_pairs(cache(spark, pages).limit(0)).count() == 0


def test_near_pairs_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "VALUES_HELD", 0)
    monkeypatch.setattr(neardup, "SETS_HELD", 0)
    pages = near_corpus()
    assert {tuple(r) for r in page_pairs(cache(spark, pages)).collect()} == brute(pages)


def test_thin_pages_of_one_template_are_no_candidates(spark):
    """300 pages that share most of their runs in threes of four words, but have more own runs than the distance."""
    rng = random.Random(6)
    frame = " ".join(f"frame{i}" for i in range(90))
    pages = [(f"https://t.example/{i}", f"<p>{frame}</p><p>{' '.join(f'own{rng.randrange(10**9)}' for _ in range(40))}</p>") for i in range(300)]
    assert len(brute(pages)) == 0
    reps = page_cells(cache(spark, pages), 0.85).where("url like 'https://t%'").selectExpr("a as sid", "n", "own", "next")
    assert candidates(reps, 0.85).count() == 0


def test_classes(spark):
    pages = near_corpus()
    got = {r.url: r for r in page_classes(cache(spark, pages)).collect()}
    want = brute(pages)
    assert all(got[a].class_id == got[b].class_id for a, b in want) and got["https://s0.example/copy1"].copies >= 25
    assert len({r.class_id for r in got.values()}) > 50


def test_classes_and_partitions():
    """Near sets meet in a class, and every changed bit changes at most one partition."""
    assert [top(n) for n in (1, 32, 33, 64, 65, 129)] == [32, 32, 64, 64, 128, 256]
    rng = np.random.default_rng(3)
    for n in (5, 32, 33, 60, 64, 65, 120, 350, 1000):
        base = np.unique(rng.integers(-(2**62), 2**62, n))
        for largest in (top(n), 2 * top(n)):
            own = cells(base, largest)
            assert len(own) == len(set(own.tolist())) > 2 * n * 0.15 / 1.85
            k = max(1, n // 10)
            other = np.unique(np.concatenate([base[k:], rng.integers(-(2**62), 2**62, k)]))
            assert len(set(own.tolist()) - set(cells(other, largest).tolist())) <= 2 * k


NAV = "<ul>" + "".join(f'<li><a href="/{x}">{x} pages</a></li>' for x in "abcde") + "</ul>"


def site(n, host, promo, foot):
    out = []
    rng = random.Random(host)
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choices(['stone', 'river', 'lamp', 'garden', 'paper', 'field'], k=25))} {i}{j}.</p>" for j in range(3))
        name = "".join(rng.choices("abcdefghij", k=8))
        extra = f"<div><p>{promo.replace('7', str(i))}</p></div>" if i % 4 == 0 else ""
        html = f'<title>t{i}</title><div>{NAV}</div><p>{host} » Shop » Headline {name}</p><div><h1>Headline {name}</h1>{body}{extra}<p>Last words of {name} about lamps and rivers.</p></div><div><h3>More</h3>{NAV}<p>{promo.replace("7", str(i))}</p></div><div><ul><li><a href="/z">Imprint</a></li></ul><p>{foot}</p></div>'
        out.append((f"https://{host}.example/{i}", html))
    return out


def test_main_body(spark):
    pages = []
    for k in range(4):
        pages += site(8, f"host{k}", f"Rated 7 out of 9 by people who shop at Host{k}.", f"Made with care by Host{k} in workshop {k}.")
    pages.append(("https://host0.example/none", "<div></div>"))
    pages.append(("https://host0.example/error", f"<div>{NAV}</div><div><h1>404</h1><p>There is nothing here any more.</p></div><div><ul><li><a href='/z'>Imprint</a></li></ul><p>Made with care by Host0 in workshop 0.</p></div>"))
    got = {}
    for r in main_blocks(cache(spark, pages)).collect():
        got.setdefault(r.url, set()).add(r.block_no)
    for u, h in pages:
        if u.rsplit("/", 1)[1].isdigit():
            i = int(u.rsplit("/", 1)[1])
            want = set(range(7, 11)) | {12 if i % 4 == 0 else 11}
            assert got[u] == want, u
    assert got["https://host0.example/error"] == {6, 7} and "https://host0.example/none" not in got and "https://broken.example/1" not in got
    assert main_blocks(cache(spark, pages).limit(0)).count() == 0


def test_sectioned_bodies_keep_all_sections(spark):
    """Sections nested three deep, and a list of links or a promotion of five lines between paragraphs."""
    text = lambda i: f"<p>{'Plain words about lamps and rivers in the garden. ' * 6}{'abcdefgh'[i] * 9}</p>"
    deep = "".join(f"<section><div><div>{text(i)}</div></div></section>" for i in range(4))
    links = "<ul>" + "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(6)) + "</ul>"
    pages = [("https://deep.example/1", f"<div>{deep}</div>"), ("https://list.example/2", f"<div>{text(0)}{text(1)}{links}{text(2)}</div>"),
             ("https://short.example/3", f"<div><p>We use cookies here.</p></div>{links}<div>{text(0)}{text(1)}{text(2)}{text(3)}</div>")]
    got = {}
    for r in main_blocks(cache(spark, pages)).collect():
        got.setdefault(r.url, set()).add(r.block_no)
    assert got["https://deep.example/1"] == {1, 2, 3, 4} and got["https://list.example/2"] == {1, 2, 9} and got["https://short.example/3"] == {8, 9, 10, 11}


def spans(weights, gaps=None, pages=None):
    none = np.zeros(len(weights), int)
    return np.flatnonzero(body_spans(np.array(weights, int), none if gaps is None else np.array(gaps), none if pages is None else np.array(pages))).tolist()


def test_spans():
    """Surges and dives of one and of several pages, against a walk over the lines."""
    assert spans([9, 0, 0, 0, 0, 8], [1, 0, 0, 0, 0, 1]) == [0, 5] and spans([9, 0, 0, 0, 0, 8]) == [0, 1, 2, 3, 4, 5]
    assert spans([5, 0, 0, 0, 0, 0, 99, 0]) == [6] and spans([0, 0, 0]) == spans([]) == []
    assert spans([5, 7, 0, 0], pages=[0, 1, 1, 2]) == [0, 1]
    rng = random.Random(3)
    for _ in range(50):
        rows = [(p, rng.choice([0, 0, 0, 3, 40, 300]), rng.random() < 0.3) for p in range(4) for _ in range(rng.randrange(0, 30))]
        want, base = [], 0
        for p in range(4):
            mine = [r for r in rows if r[0] == p]
            walk = [x for i, (_, w, g) in enumerate(mine) for x in ([(0, None)] * g + [(w, i)])]
            found, begin = [], None
            for j, (w, i) in enumerate(walk):
                if w:
                    if begin is None:
                        begin, mass, full = i, 0, 0
                    mass, full, last, at = mass + w, full + 1, i, j
                if begin is not None and (j - at >= 5 or j == len(walk) - 1):
                    found.append((mass, full, begin, last))
                    begin = None
            most = max((x[0] for x in found), default=0)
            want += [base + i for mass, full, b, e in found if mass >= 0.25 * most or (mass >= 200 and mass >= 60 * full) for i in range(b, e + 1)]
            base += len(mine)
        assert spans([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows]) == want


def test_many_keys_are_joined_with_the_same_result(spark, monkeypatch):
    pages = [x for k in range(4) for x in site(8, f"host{k}", f"Rated 7 out of 9 by people who shop at Host{k}.", f"Made with care by Host{k} in workshop {k}.")]
    few = sorted(map(tuple, main_blocks(cache(spark, pages)).collect()))
    monkeypatch.setattr(mainbody, "KEYS_HELD", 0)
    assert sorted(map(tuple, main_blocks(cache(spark, pages)).collect())) == few


def test_copies_on_a_small_site_are_no_frame(spark):
    body = "".join(f"<p>{'The same words on many pages of this small site. ' * 3}{i}</p>" for i in "abc")
    pages = [(f"https://few.example/{i}", f"<title>Copy {i}</title>{NAV}<h1>Copy</h1>{body}{NAV}") for i in range(6)]
    pages += [(f"https://few.example/own{i}", f"<title>Own {'xyz'[i]}</title>{NAV}<h1>Own {'xyz'[i]}</h1><p>{'Words of its own. ' * 9}{'xyz'[i]}</p>{NAV}") for i in range(3)]
    got = {}
    for r in main_blocks(cache(spark, pages)).collect():
        got.setdefault(r.url, set()).add(r.block_no)
    assert all(got[u] == ({6, 7, 8, 9} if "own" not in u else {6, 7}) for u, _ in pages)


def test_headings_of_one_name_are_not_frame_text(spark):
    """'Related' and site names stand in frames on all sites; bodies have headings of one word too."""
    pages = []
    for k in range(4):
        name = f"Brand{'abcd'[k]}"
        for i, (u, h) in enumerate(site(8, f"host{k}", f"Rated 7 out of 9 by people who shop at Host{k}.", f"Made with care by Host{k} in workshop {k}.")):
            word = ["Gone", "Warning", "Sanos", "Kedra"][i % 4]
            body = h[h.index("<h1>") :].replace("<h3>More</h3>", f"<h3>Related</h3><h2>{name}</h2>" + (f"<h2>{word}</h2>" if k == 3 else ""))
            pages.append((u, f"<div>{NAV}</div><div><h1>{word}</h1>" + body[body.index("</h1>") + 5 :]))
    got = {(r.url, r.block_no) for r in main_blocks(cache(spark, pages)).collect()}
    for u, h in pages:
        first = h[: h.index("<h1>")].count("<li>") + 1
        assert (u, first) in got and (u, first + 1) in got, u
        assert (u, page_lines(h)[1][[x.text for x in page_lines(h)[1]].index("Related")].no) not in got


def test_lines():
    title, lines = page_lines("<title>T &amp; t</title><p>One <a href=x>two</a></p><li>three<li><!-- <p>no</p> --><p><code>{{x}}</code> y <b>z</b></p>")
    assert title == "T & t" and [(x.no, x.text) for x in lines if x.no] == [(1, "One two"), (2, "three"), (3, ""), (4, "{{x}} y z")]
    assert [x.bare for x in lines if x.no] == ["One two", "three", "", "y z"] and lines[0].linked == 3
    assert page_lines("x" * 300_000)[1][0].text == "x" * 300_000 and page_lines("")[1] == []


def test_residue_units():
    for x in ("Dear {{ name }}", "%%CITY%% news", "<%= price %>", "[INSERT date]", "*|X|*", "null – null", "Hi %(name)s", "[object Object]", "a ${b} c", "@@TITLE@@ here"):
        assert has_placeholder(x), x
    for x in ("Write “{{ name }}” there", "100 % sure", "a {b c", "snake__case", "50%discount", "{ }", "undefined()", "me@home.example"):
        assert not has_placeholder(x), x
    assert trusted_label("lorem ipsum dolor") == "filler" and trusted_label("text text text text text") == "filler"
    assert trusted_label("you need to enable javascript to run this app.") == "message" and trusted_label("a short history of dummy text") is None
    assert trusted_label("a good “page not found” message is short.") is None
    texts = [unit_wording(x) for x in ("Request 12 failed", "Request 99 failed", "x", "a b " * 500, "Request 99 failed")]
    sim = simhashes([*texts, ""])
    assert sim[0] == sim[1] == sim[4] and [simhashes([x])[0] for x in texts] == sim[:5].tolist()


def test_residue_pages(spark):
    pages = []
    for k in range(3):
        pages += site(8, f"host{k}", f"Rated 7 out of 9 by people who shop at Host{k}.", f"Made with care by Host{k} in workshop {k}.")
    frame = lambda main, title="t": f"<title>{title}</title><div>{NAV}</div><div>{main}</div><div><ul><li><a href='/z'>Imprint</a></li></ul><p>Made with care by Host1 in workshop 1.</p></div>"
    long = "<p>" + "Plain words about lamps and rivers in the garden. " * 12 + "</p>"
    cases = {
        "a": frame("<h1>404</h1><p>Sorry, the page you asked for was not found here or has been moved.</p>"),
        "b": frame(f"<h1>X</h1>{long}<p>Hello {{{{ first_name }}}}</p>"),
        "c": frame(f"<h1>X</h1>{long}", title="{{ page_title }}"),
        "d": frame("<h1>X</h1><p>Lorem ipsum dolor sit amet.</p>"),
        "e": frame("<p>Sorry, the page you asked for was not found here or has been movedd.</p>"),
    }
    clean = {
        "f": frame(f"<h1>Errors</h1>{long}<p>Sorry, the page you asked for does not exist or has been moved.</p>"),
        "g": frame(f"<h1>X</h1>{long}<p>Use <code>{{{{ name }}}}</code> there.</p>"),
        "h": frame(f"<h1>X</h1>{long}<!-- {{{{ x }}}} --><script>var a='{{{{x}}}}'</script><noscript>You need to enable JavaScript.</noscript>"),
    }
    more = [(f"https://host1.example/{k}", v) for k, v in {**cases, **clean}.items()]
    got = {r.url[-1] for r in residue_pages(cache(spark, pages + more)).collect() if r.url.startswith("https://host1") and r.url[-1].isalpha()}
    assert got == set(cases)
    assert residue_pages(cache(spark, more).limit(0)).count() == 0


def test_propagation_finds_all_links_of_its_definition(spark):
    """Reworded variants that no listed wording matches, against a brute-force walk at similarity 0.8 and 15 bits."""
    rng = random.Random(8)
    texts = ["Sorry, what you asked for is not here or went to some other place by its owner.", "We are sorry but our machines met an odd condition while they were working on your request today."]
    units = [unit_wording(x) for x in texts]
    for _ in range(300):
        words = rng.choice(units).split()
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=rng.choice([2, 4, 7])))
        units.append(" ".join(words))
    units = list(dict.fromkeys(units))
    sims = dict(zip(units, simhashes(units).tolist(), strict=True))
    near = {a: [b for b in units if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))] for a in units}
    close = {a: [b for b in near[a] if ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() <= 15] for a in units}
    pairs, kept = sum(map(len, near.values())) - len(units), sum(map(len, close.values())) - len(units)
    assert kept >= 0.97 * pairs > 500  # the distance fits the similarity
    known, ring = set(units[:2]), units[:2]
    while ring:
        ring = [w for w in dict.fromkeys(x for r in ring for x in close[r]) if w not in known]
        known |= set(ring)
    rows = spark.createDataFrame([(i, x, sims[x]) for i, x in enumerate(units)], "id long, wording string, sim long")
    got = propagate(rows, rows, spark.createDataFrame([(0, "message"), (1, "message")], "id long, label string")).collect()
    assert {r.id for r in got} == {i for i, x in enumerate(units) if x in known} and len(known) > 100 and all(trusted_label(x) is None for x in known)
    assert propagate(rows, rows, spark.createDataFrame([], "id long, label string")).count() == 0


def test_failed_pages_teach_their_wording(spark):
    """Messages of no listed wording: trusted where the crawl saw failures, propagated to the others; real content stays."""
    pages = [x for k in range(3) for x in site(8, f"host{k}", f"Rated 7 out of 9 by people who shop at Host{k}.", f"Made with care by Host{k} in workshop {k}.")]
    say = ["Die angeforderte Seite existiert leider nicht mehr, Nummer 12.", "Die angeforderte Seite existiert leider nicht mehr, Nummer 99.", "Die angeforderte Seite existiert leider jetzt nicht mehr, Nummer 3."]
    long = "<p>" + "Plain words about lamps and rivers in the garden. " * 12 + "</p>"
    more = [(f"https://host{i}.example/m{i}", f"<title>m</title><div>{NAV}</div><div><h1>M</h1><p>{x}</p></div>") for i, x in enumerate(say)]
    more += [("https://host0.example/own", f"<div>{NAV}</div><div><p>Only a short note of our own.</p></div>"), ("https://host1.example/real", f"<div>{NAV}</div><div>{long}<p>{say[0]}</p></div>")]
    status = spark.createDataFrame([(more[0][0], 404), (more[1][0], 404), ("https://host0.example/own", 404), ("https://host1.example/real", 503), (None, 404), (more[2][0], None)], "url string, status int")
    got = {r.url: (r.reason, r.trusted) for r in residue_pages(cache(spark, pages + more), status).collect()}
    assert got == {more[0][0]: ("message", True), more[1][0]: ("message", True), more[2][0]: ("message", False)}
    assert residue_pages(cache(spark, pages + more)).count() == 0


def test_residue_outside_blocks_and_in_long_texts(spark):
    long = "Plain words about lamps and rivers in the garden. " * 12
    trace = "Fatal error: Uncaught Exception: no row in /srv/app/a.php on line 7 stack trace: " + " ".join(f"#{i} /srv/app/lib/part{i}.php(12): Thing->call()" for i in range(12))
    work = "Our site is down for maintenance until six. " + "We are working on our servers and the shop is undergoing maintenance. " * 5 + "Thank you for your patience, we will be back soon. " * 3
    cases = {
        "https://a.example/1": "<body>Fatal error: Call to a member function on null in /srv/a.php on line 9</body>",
        "https://b.example/1": "<div>Please enable JavaScript to run this app.</div>",
        "https://c.example/1": f"<p>{long}</p><table><tr><td>Name</td><td>{{{{ name }}}}</td></tr></table>",
        "https://d.example/1": f"<p>{trace}</p>", "https://e.example/1": f"<h1>Soon</h1><p>{work}</p>",
    }
    clean = {
        "https://f.example/1": f"<div>{long}</div><p>Please enable JavaScript to run this app.</p>", "https://g.example/1": f"<p>{long}</p><div><code>{{{{ x }}}}</code> is a form</div>",
        "https://h.example/1": f"<p>A maintenance page may say that the site is down for maintenance. {long}</p>",
    }
    got = {r.url: r.reason for r in residue_pages(cache(spark, [*cases.items(), *clean.items()])).collect()}
    assert got == dict.fromkeys(cases, "message") | {"https://c.example/1": "placeholder"}
