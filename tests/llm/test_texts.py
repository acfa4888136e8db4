"""Packing, mixing and encodings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import encoding as E
from auditloom.llm.mixing import mix_documents, mix_marginals, mix_shares, rake
from auditloom.llm.packing import pack, packing_report, sum_of_squares
from auditloom.llm.tokens import encoder, with_tokens


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def slow_rule(sizes, capacity):
    gaps, count, cost, out = [], {}, 0, []
    for s in sizes:
        best = None
        for g in [*sorted({g for g in gaps if g >= s}), None]:
            c = dict(count)
            if g is not None:
                c[g] -= 1
            left = (g if g is not None else capacity) - s
            if left:
                c[left] = c.get(left, 0) + 1
            v = sum(x * x for x in c.values())
            if best is None or v < best[0]:
                best = (v, g, c)
        _, g, count = best
        i = len(gaps) if g is None else max(i for i, x in enumerate(gaps) if x == g)
        if g is None:
            gaps.append(capacity)
        gaps[i] -= s
        cost = best[0]
        out.append(cost)
    return out


def costs(sizes, boxes, capacity):
    fill, out = {}, []
    for s, b in zip(sizes, boxes):
        fill[b] = fill.get(b, 0) + s
        n = {}
        for f in fill.values():
            if f < capacity:
                n[f] = n.get(f, 0) + 1
        out.append(sum(x * x for x in n.values()))
    assert max(fill.values()) <= capacity
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=25))
def test_each_step_is_the_best(sizes):
    boxes = sum_of_squares(np.array(sizes), 12)
    assert costs(sizes, boxes.tolist(), 12) == slow_rule(sizes, 12)


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 5, 60, 99, 100, 101, 350])) for i in range(500)] + [(900, 0), (901, None)]
    items = spark.createDataFrame(sizes, "id long, tokens int")
    specs = spark.createDataFrame([(1, 100), (1, 100), (2, 1000), (3, 0), (4, None)], "spec_id long, capacity_tokens int")
    for share in (40_000, 60):
        got = pack(items, specs, share).collect()
        for spec, cap in ((1, 100), (2, 1000)):
            mine = [r for r in got if r.spec_id == spec]
            assert sum(r.tokens for r in mine) == sum(s or 0 for _, s in sizes)
            fill, pieces = {}, {}
            for r in mine:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
                pieces.setdefault(r.id, []).append(r)
            assert max(fill.values()) <= cap
            for i, s in sizes:
                ps = sorted(pieces.get(i, []), key=lambda r: r.piece_no)
                assert [r.first_token for r in ps] == [cap * k for k in range(len(ps))] and (len(ps) <= 1 or s > cap)
        assert {r.spec_id for r in got} == {1, 2}
    assert packing_report(pack(items, specs), specs).where("spec_id = 2").first().used_share > 0.9
    assert pack(items.limit(0), specs).count() == 0 and pack(items, specs.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "é" * 5000)], "k long, text string")
    got = {r.k: r.tokens for r in with_tokens(df, "text", ["k"]).collect()}
    from auditloom.llm.tokens import VOCABULARIES, VOCABULARY

    e = encoder(f"{VOCABULARIES}/{VOCABULARY}")
    assert got == {1: len(e.encode_ordinary("Hello world")), 4: len(e.encode_ordinary("é" * 5000))}
    assert e.decode(e.encode_ordinary("Zażółć — ok")) == "Zażółć — ok"


def test_rake():
    rng = np.random.default_rng(0)
    src, lang = np.repeat(np.arange(4), 5), np.tile(np.arange(5), 4)
    tokens = rng.integers(50, 500, 20).astype(float)
    caps = tokens * 2
    target = np.array([0.4, 0.3, 0.2, 0.1]) * 1500
    share = np.full(5, 300.0)
    w = rake(tokens, caps, [(src, target), (lang, share)])
    assert np.allclose(np.bincount(src, w), target, rtol=1e-6) and (w <= caps * (1 + 1e-9)).all()
    assert np.allclose(np.bincount(lang, w), share, rtol=0.05)


def test_mixing(spark):
    rng = random.Random(0)
    docs = []
    for i in range(900):
        source = "big" if i % 3 else rng.choice(["small", "mid", "mid", "mid"])
        docs.append((i, " ".join(rng.choices(["red", "green", "blue", "grey"], k=rng.choice([5, 30, 80]))) + f" {i}", rng.choice(["en", "de", None]), source, rng.choice(["note", None]), "x"))
    docs += [(2000, docs[5][1], "en", "big", "note", "x"), (2001, None, "en", "big", "note", "x"), (2002, "", "en", "small", "note", "x"), (2003, "text without source", "en", None, "note", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, doc_kind string, tokens string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("m", "small", 0.2, 3), ("gap", "absent", 0.5, 1), ("gap", "mid", 0.5, 2), ("none", "absent", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mix_documents(df, targets)
    got = {(r.mix_name, r.source): r for r in mix_shares(mixed, targets).collect()}
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)):
        assert abs(got["m", s].actual_share - share) < 0.01 and got["m", s].most_uses <= cap
    assert got["gap", "absent"].actual_share == 0 and got["gap", "mid"].actual_share == 1.0 and got["none", "absent"].tokens == 0
    marks = mix_marginals(mixed.where("mix_name = 'm'"), df).collect()
    for dimension, values in (("lang", {"en", "de", "?"}), ("doc_kind", {"note", "?"})):
        own = {r.value: r.share for r in marks if r.dimension == dimension}
        assert set(own) == values and abs(sum(own.values()) - 1) < 0.001 and max(own.values()) < 1.5 / len(values)
    ids = {r.doc_id for r in mixed.collect()}
    assert not ids & {2000, 2001, 2002, 2003} or 5 not in ids
    assert mix_documents(df.limit(0), targets).count() == 0 and mix_documents(df, targets.limit(0)).count() == 0


@pytest.mark.parametrize("pair", E.PAIRS)
def test_round_trip(pair):
    texts = ["Größe über Ärger", "czę", "Привет", "“quoted” — é", "plain"]
    done = 0
    for t in texts:
        wrong = E.misread(t, pair)
        if wrong is not None:
            assert E.reread(wrong, pair) == t
            done += 1
    assert done >= 2


SENTENCES = {
    "de": ["Die Größe der Überschrift wurde geändert.", "Für häufige Fehler gibt es müde Gründe.", "Schöne Grüße aus München über die Straße.", "Das Menü enthält künftig ähnliche Einträge."],
    "fr": ["Le résumé généré répète la même présentation.", "L’équipe éditoriale a remplacé la clé définie.", "Une entrée très répétée a été déplacée à côté.", "La catégorie « été » mérite un détail."],
    "ru": ["Заголовок статьи требует проверки.", "Кнопка заказа обновляет раздел вопросов.", "Старый адрес не открывает изображение.", "Проверка ссылок повторяет ошибки."],
    "pl": ["Zespół śledzący wyniki spowalnia tłumaczenie.", "Większy obraz wyprzedził tytuł ósmej części.", "Strona główna łączy się z długą ścieżkę.", "Użytkownik później zauważył błędy."],
    "en": ["The editor’s draft “quick guide” costs €20.", "A plain sentence without any special sign.", "The crawler — we think — hides pages.", "It’s a café in the old town."],
}


def corpus(n, seed):
    rng = random.Random(seed)
    out, truth = [], {}
    for i in range(n):
        lang = rng.choice(list(SENTENCES))
        parts = [rng.choice(SENTENCES[lang]) for _ in range(rng.choice([1, 3, 8]))]
        if i % 10 == 0:
            pair = rng.choice([("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1), ("cp1251", "cp1252", 1), ("cp1250", "cp1252", 1), ("cp1252", "mac_roman", 1), ("utf-8", "cp850", 1)])
            at = rng.randrange(len(parts))
            wrong = E.misread(parts[at], pair)
            if wrong and wrong != parts[at]:
                truth[i] = " ".join(parts)
                parts[at] = wrong
        elif i % 17 == 0:
            parts.append("In the report “Ã©” stands where an é should be.")
        elif i % 19 == 0:
            parts.append("SÃO TOMÉ and ÇA VA are names.")
        out.append((i, " ".join(parts)))
    return out, truth


def test_viterbi_of_many_sequences_is_that_of_each():
    """Against a walk that compares all pairs of states, for sequences of all lengths at once."""
    move = np.full((E.STATES, E.STATES), E._OTHER)
    move[0, :], move[:, 0] = E._ENTER, E._LEAVE
    np.fill_diagonal(move, E._STAY)
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 700)
    steps = rng.normal(-4, 4, (sizes.sum(), E.STATES)).astype(np.float32)
    steps[:, 0] += 6
    got = E.viterbi(steps, sizes)
    at = 0
    for n in sizes.tolist():
        best, back = E._START + steps[at] if n else None, []
        for x in steps[at + 1 : at + n]:
            reach = best[:, None] + move
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + x
        path = [int(best.argmax())] if n else []
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[at : at + n].tolist() == path[::-1]
        at += n


def test_misread_documents(spark):
    docs, truth = corpus(1500, 1)
    lost = [(9001, "Die Gr��e der �berschrift wurde ge�ndert."), (9002, "Die Gr??e der ?berschrift wurde ge?ndert und ver?ffentlicht.")]
    clean = [(9003, None), (9004, ""), (9005, "See https://e.com/list?page=2 and https://e.com/a?b=c now? Yes?"), (9006, "Ünïcödé " * 20000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs + lost + clean + docs[:1]], "doc_id long, text string, states string")
    got = {}
    for r in E.misread_documents(df).collect():
        got[r.id] = r
    found = set(got) - {9001, 9002, 9006}
    assert len(found & set(truth)) >= 0.97 * len(truth) and len(found - set(truth)) <= 0.02 * len(truth)
    restored = sum(got[i].restored == t for i, t in truth.items() if i in got)
    assert restored >= 0.95 * len(truth)
    assert {9001, 9002} <= set(got) and got[9001].lost == 1
    assert E.misread_documents(df.limit(0)).count() == 0


def worded(n, letters, seed, first=20000):
    """Sentences of made-up words of ``letters``, some misread as UTF-8 in another encoding."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(120)]
    out, truth = [], {}
    for i in range(first, first + n):
        parts = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(3)]
        if i % 7 == 0:
            truth[i] = " ".join(parts)
            parts[1] = E.misread(parts[1], rng.choice([p for p in E.PAIRS if p[0] == "utf-8"]))
        out.append((i, " ".join(parts)))
    return out, truth


@pytest.mark.parametrize("held", [0, 7, 500])
def test_pairs_that_no_task_holds_count_as_well(spark, monkeypatch, held):
    """Results, and the model, are those of all pairs whatever is held."""
    docs = corpus(300, 1)[0] + worded(200, "αβγδεζηθικλμνξοπρστυφχψω", 2)[0] + worded(200, [chr(0xAC00 + 37 * i) for i in range(60)], 3, 21000)[0]
    docs += docs[-9:] + [(9001, "Die Gr��e der �berschrift wurde ge�ndert."), (9003, None), (9004, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    every, sums, rest = E.character_counts(df.select("text"))
    assert sums == {} and rest is None
    whole, results = E.Model(every), rows(E.misread_documents(df))
    assert len(results) > 60
    monkeypatch.setattr(E, "MAX_BIGRAMS", held)
    monkeypatch.setattr(E, "_COUNTED", 40)
    assert rows(E.misread_documents(df)) == results
    some, sums, rest = E.character_counts(df.select("text"))
    assert {**some, **{r.code: r.n for r in rest.collect()}} == every and len(every) > len(some)
    model = E.Model(some, sums)
    assert (model.keys == whole.keys).all() and (model.table == whole.table).all()


def test_rare_pairs_beside_more_frequent_ones_than_are_held(spark):
    rng = np.random.default_rng(4)
    filler = ["".join(map(chr, x)) for x in 0x4E00 + rng.integers(0, 520, (400, 7000))]
    docs, truth = worded(28, [chr(0xAC00 + 20 * i) for i in range(500)], 5)
    df = spark.createDataFrame(docs + list(enumerate(filler)), "doc_id long, text string")
    got = {r.id: r.restored for r in E.misread_documents(df).collect()}
    assert set(got) == set(truth) and sum(got[i] == t for i, t in truth.items()) >= 0.9 * len(truth)
