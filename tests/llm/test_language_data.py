"""Operators for language data, against brute force, exact round trips and held-out accuracy."""

import random
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quire.llm import encoding, language, leakage, packing, quality, queries, splitting, textform
from quire.llm.boilerplate import Boilerplate
from quire.llm.tokens import rank_file, tokenizer

BLOCKS = "site string, doc_id bigint, block_id string, page_index int, raw_text string"
EN = ["The rotor seat is spaced apart from the valve body in the closed position.", "It has been found that the pump arm can be detached from the frame.", "There is a need for a device which is easy to clean and which does not leak."]
DE = ["Die Kolbenplatte ist entlang der Längsachse mit dem Gehäuse verbunden.", "Es hat sich gezeigt, dass der Pumpenarm von dem Rahmen gelöst wird.", "Aufgabe ist es, eine Vorrichtung zu schaffen, die nicht tropft und die leicht zu reinigen ist."]
ES = ["Se ha comprobado que el brazo de la bomba se puede separar del bastidor.", "La tapa de la válvula, que toca el rotor, está hecha de aluminio.", "Aún no se sabe cuándo el eje soporta la palanca y por qué."]


# 2: consistent form
@pytest.mark.parametrize(("text", "form", "variant"), [
    ("Ｔhe ｖalve．", "The valve.", True), ("рlaquе de рistоn", "plaque de piston", True), ("a​b­c", "abc", True), ("été", "été", True), ("й", "й", True), ("ﬁlter", "filter", True), ("a b c", "a b c", True),
    ("Unofficial reading сору supplied", "Unofficial reading copy supplied", True), ("with а colleague", "with a colleague", True), ("Haзначениe фланец", "Назначение фланец", True), ("4,46 μm, 5 °C, μM, kΩ", "4,46 μm, 5 °C, μM, kΩ", False), ("10⁻³ CO₂ … – ‘x’", "10⁻³ CO₂ … – ‘x’", False),
    ("25а и 26b", "25а и 26b", False), ("О том, что с ним", "О том, что с ним", False), ("a\tb\r\nc", "a\tb\r\nc", False), ("", "", False), ("x" * 100_000, "x" * 100_000, False), ("z̄", "z̄", False),
])
def test_form(text, form, variant):
    new, flags = textform.canonical_array(pa.array(["plain", text, None]))
    assert new.to_pylist() == ["plain", form, None] and flags.tolist() == [False, variant, False]


def test_form_without_invisible_characters():
    for cp in (*range(0x00, 0x09), *range(0x0E, 0x1C), 0x1F, 0x7F, 0x80, 0x9F, 0xAD, 0x180B, 0x200B, 0xFE0F, 0x110BD, 0x1D173, 0xE0001, 0xE0041, 0xE007F, 0xE0100, 0xE01EF):
        new, flags = textform.canonical_array(pa.array([f"val{chr(cp)}ve", "valve"]))
        assert new.to_pylist() == ["valve", "valve"] and flags.tolist() == [True, False], hex(cp)
    for cp in (0x0B, 0x0C, 0x1C, 0x1E, 0x85, 0x2028, 0x2029):
        assert textform.canonical_array(pa.array([f"the{chr(cp)}valve"]))[0].to_pylist() == ["the\nvalve"], hex(cp)
    for ch in "\t\n\r\U00020000\U0002F800\U000F0000\U0010FFFD":
        assert textform.canonical_array(pa.array([f"a{ch}b"]))[1].tolist() == [False], hex(ord(ch))


def test_variants_with_ascii_controls(spark, tmp_path):
    box = "struct<title:string,toc_level:int,page_label:string,target_id:string>"
    texts = [EN[0], EN[1].replace("pump", "pu\x07mp"), EN[2].replace(" ", "\t", 1), DE[1], EN[0].replace("valve", "val\x7fve")]
    spark.createDataFrame([("s", 1, f"b{i}", 0, t) for i, t in enumerate(texts)], BLOCKS).write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([(1, "e", [])], f"doc_id bigint, element_id string, toc_entries array<{box}>").write.parquet(str(tmp_path / "elements.parquet"))
    assert {r.record_id for r in queries.p2_found(spark, str(tmp_path)).collect()} == {"b1", "b4"}


def test_form_composes_like_unicode():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "e", "o", "u", "n", "c", " ", "́", "̈", "̃", "̧"]) for _ in range(30)) for _ in range(200)]
    texts = [unicodedata.normalize("NFD", unicodedata.normalize("NFC", t)) for t in texts]
    once = [unicodedata.normalize("NFD", t) for t in textform.canonical_array(pa.array(texts))[0].to_pylist()]
    assert once == texts


def test_codepoints_round_trip():
    texts = ["", "ab", "äö", "𝒳€", None, "x"]
    cps, offsets = textform.codepoints(pa.array(texts))
    assert textform.to_arrow(cps, offsets).to_pylist() == ["" if t is None else t for t in texts]
    sliced = pa.array(texts).slice(2, 3)
    assert textform.to_arrow(*textform.codepoints(sliced)).to_pylist() == ["äö", "𝒳€", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "bb", "", "c" * 50])], names=["t"])
    assert [b.num_rows for b in textform.slices([batch], "t", 5)] == [1, 2, 1]


# 1: repeated lines
def test_boilerplate_against_brute_force(spark):
    rng = random.Random(3)
    notices = ["Rate this document: 12 readers liked it", "© 2019 Site. All rights reserved here", "Click the drawing to enlarge it"]
    rows = []
    for d in range(20):
        for b in range(3):
            ls = [f"unique line of document {''.join(rng.choices('abcdefgh', k=12))}"]
            if rng.random() < 0.4:
                n = rng.choice(notices)
                ls.insert(rng.randint(0, 1), rng.choice([n, n.upper(), n.replace("12", "99"), n.replace("e", "е", 1), "  " + n + " *"]))
            rows.append(("s" if d < 15 else None, d, f"p0001-b{b:04d}", 0, "\n".join(ls)))
    rows += [rows[0], ("s", 1, "p0001-b0009", 0, None), ("s", 1, "p0001-b0010", 0, "short")]
    df = spark.createDataFrame(rows, BLOCKS)

    def key(line):
        line = unicodedata.normalize("NFKC", line).replace("е", "e").casefold()
        return "".join(c for c in line if c.isalpha())

    docs, held, where = {}, {}, {}
    for site, d, b, _, text in rows:
        docs.setdefault(site, set()).add(d)
        for i, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= 10:
                held.setdefault((site, key(line)), set()).add(d)
                where.setdefault((site, key(line)), set()).add((d, b, i))
    expected = {x for k, ds in held.items() if len(ds) >= 3 and len(ds) * 5 >= len(docs[k[0]]) for x in where[k]}
    made = Boilerplate(df)
    assert expected and {(r.doc_id, r.block_id, r.line_no) for r in made.found().collect()} == expected
    cleaned = {(r.doc_id, r.block_id): r for r in made.cleaned().collect()}
    for d, b, i in expected:
        assert cleaned[d, b].lines_removed == 1
    assert cleaned[1, "p0001-b0009"].clean_text is None
    assert Boilerplate(df.limit(0)).found().count() == 0


# 5: wrong encodings
def corpus():
    rng = random.Random(2)
    return [" ".join(rng.sample(EN + DE + ES, 3)) + " Если упор ротора касается вала, остаётся щель шириной 5 мм." for _ in range(400)]


@pytest.fixture(scope="module")
def repairer():
    _, k = encoding.classes()
    total = {}
    for t in corpus():
        cps, _ = textform.codepoints(pa.array([t]))
        c = encoding.classes()[0][cps].astype(int)
        for a, b in zip(c[:-1].tolist(), c[1:].tolist()):
            total[a, b] = total.get((a, b), 0) + 1
    a, b = (np.array(x) for x in zip(*total))
    return encoding.Repairer(encoding.PairModel(a, b, np.array(list(total.values()))))


def check(repairer, text):
    cps, _ = textform.codepoints(pa.array([text]))
    return repairer.text(text, repairer.model.information(cps))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250"])
def test_restores_bytes_read_one_by_one(repairer, wrong):
    for clean in DE + ES:
        bad = clean.encode().decode(wrong, "replace")
        found, new, whole = check(repairer, bad)
        assert found == (bad != clean) and (not found or "�" in bad or (new == clean and whole))


def test_restores_other_encodings(repairer):
    clean = "Если упор ротора касается вала, остаётся щель шириной"
    for wrong, right in (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251")):
        found, new, _ = check(repairer, clean.encode(right).decode(wrong))
        assert found and sum(a == b for a, b in zip(new, clean)) > 0.9 * len(clean)
    twice = DE[0].encode().decode("cp1252").encode().decode("cp1252")
    assert check(repairer, twice)[1] == DE[0]
    assert check(repairer, "Die L�ngsachse")[::2] == (True, False)
    for clean in EN + DE + ES + ["5 °C, ±3 μm, √2 ≈ 1.41, «x» – “y”", "DIE LÄNGSACHSE DES GEHÄUSES"]:
        assert not check(repairer, clean)[0], clean


def test_maximum_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        score = rng.integers(-5, 6, 12).astype(float)
        segs = encoding.improbable_segments(score)
        best = max([0.0] + [score[i:j].sum() for i in range(12) for j in range(i + 1, 13)])
        assert max([0.0] + [score[s:e].sum() for s, e in segs]) == best


def test_find_garbled_on_tables(spark):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(1000, DE[0].encode().decode("cp1252")), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, t string")
    model = encoding.collect_model(encoding.pair_counts(df, "t"))
    assert [(r.doc_id, r.restored, r.recoverable) for r in encoding.find_garbled(df, "t", model).collect()] == [(1000, DE[0], True)]
    empty = df.limit(0)
    assert encoding.find_garbled(empty, "t", encoding.collect_model(encoding.pair_counts(empty, "t"))).count() == 0


# 6: languages
def test_languages(spark):
    rows = pd.DataFrame([(s, lang) for lang, ss in (("en", EN), ("de", DE), ("es", ES)) for s in ss] * 20, columns=["text", "lang"])
    model = language.train(rows)
    langs, confidence, complete = language.classify(model, ["The body of the valve is not easy to clean.", "Der Rahmen ist mit der Platte verbunden.", "valve seat valve seat valve seat valve seat.", "12, 13, 14.", "La bomba se puede separar de la tapa.", "Mounting of the seat"])
    assert langs[:2] == ["en", "de"] and langs[3] is None and langs[4] == "es" and complete.tolist() == [True, True, False, False, True, False]
    assert (confidence[:2] > 0.9).all()
    p = spark.createDataFrame([(1, "a", EN[0] + " " + DE[1]), (1, "a", EN[0] + " " + DE[1]), (1, "b", None), (2, "a", ES[0]), (3, "a", "")], "doc_id bigint, element_id string, text string")
    ir = spark.createDataFrame([(1, {"dc:language": "en-GB; Spanish", "title": "Deutsch"}), (2, {"Language": "español"}), (3, None)], "doc_id bigint, metadata map<string,string>")
    assert {(r.doc_id, r.lang) for r in language.named_languages(ir).collect()} == {(1, "en"), (1, "es"), (2, "es")}
    assert [tuple(r) for r in language.unnamed_languages(p, ir, model).collect()] == [(1, "a", "de")]
    assert {r.doc_id: r.lang for r in language.document_languages(p, model).collect()} == {1: "en", 2: "es"}
    seg = language.foreign_segments(p, model).collect()
    assert [(r.lang, (EN[0] + " " + DE[1])[r.start : r.start + r.length]) for r in seg] == [("de", DE[1])]
    assert language.unnamed_languages(p.limit(0), ir, language.language_model(p.limit(0), ir)).count() == 0


def test_code_lengths_are_exact():
    tree = language.ContextTree({"aab": 3, "ab": 1}, order=2)
    for context, (coded, escape) in tree.nodes.items():
        assert abs(sum(2**-x for x in coded.values()) + 2**-escape - 1) < 1e-9, context


# 4: quality
def test_quality(spark):
    rng = random.Random(5)
    prose = [(d, f"p{i}", " ".join(rng.sample(EN, 2))) for d in range(30) for i in range(3)]
    lists = [(100 + d, f"p{i}", "\n".join(f"{j}) valve seat {rng.randint(1, 99)};" for j in range(8))) for d in range(5) for i in range(2)]
    salad = [(200, "p0", "valve seat " * 40), (201, "p0", None), (202, "p0", ""), (203, "p0", "x" * 100_000)]
    df = spark.createDataFrame([*prose, *lists, *salad, lists[0]], "doc_id bigint, element_id string, text string")
    assert {r.doc_id for r in quality.not_prose(df).collect()} == {100, 101, 102, 103, 104, 200, 203}
    rows = quality.paragraph_distances(df).where("distance is not null").collect()
    assert all(abs(sum(r[f"from_{s}"] for s in quality.STATISTICS) - r.distance) < 1e-6 * max(1, r.distance) for r in rows)
    assert quality.document_quality(df.limit(0)).count() == 0


# 7: containers
def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(7)
    for _ in range(30):
        sizes, capacity = rng.integers(0, 60, rng.integers(1, 200)), 100
        room, expected = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(capacity)
            room[k] -= sizes[i]
            expected[i] = k
        assert packing.first_fit_decreasing(sizes, capacity).tolist() == expected.tolist()


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["valve", "rotor", "seat"], k=rng.randint(1, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 500)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string")
    placed = packing.pack(df, capacity=128, group_size=100).toPandas()
    used = placed.groupby("container_id").n_tokens.sum()
    assert used.max() <= 128 and set(placed.doc_id) == {r[0] for r in rows}
    count = tokenizer(rank_file()).count
    assert placed.groupby("doc_id").n_tokens.sum().to_dict() == {i: count(t) if t else 0 for i, t in rows}
    assert (placed[placed.doc_id < 900].groupby("doc_id").size() == 1).all() and used.sum() / (128 * len(used)) > 0.95
    assert packing.pack(df.limit(0)).count() == 0


# 8: leaks
def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    frame = "A narrow {} near {} holds {} measures of {} and loses {} every week while the keeper of {} writes that the {} turned green after {} nights of frost in {} again"
    items = [(i, frame.format(word(), word().title(), rng.randint(10, 99), word(), rng.randint(10, 99), word().title(), word(), rng.randint(10, 99), word().title())) for i in range(40)]
    filler = " ".join(word() for _ in range(50))
    text = items[3][1]
    docs = [
        (1, f"{filler}. {text.upper()} {filler}"), (2, filler + " " + text.replace(" ", "\n").replace(",", ";")), (3, filler + " " + " ".join(text.split()[:23])), (4, filler + " " + " ".join(text.split()[2:27]).replace("measures", "litres")),
        (5, frame.format(word(), word(), 7, word(), 8, word(), word(), 9, word())), (6, None), (7, ""), (8, text.replace("a", "а")), (9, " ".join(w if i % 5 else word() for i, w in enumerate(text.split()))),
    ]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id bigint, text string")
    it = spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")
    found = leakage.find_leaks(d, it, reparameterised=True).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.kind == "verbatim"} == {(1, 3), (2, 3), (4, 3), (8, 3)}
    assert {r.doc_id for r in found if r.kind == "reparameterised"} >= {5}
    assert leakage.find_leaks(d, it.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), it).count() == 0
    small = leakage.find_leaks(d, it, block=7)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(1, 3), (2, 3), (4, 3), (8, 3)}


def test_names_of_any_number_of_items(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    frame = "A narrow {} near {} holds some measures of {} and loses much every week while the keeper of {} writes that the old gate turned green after long frost in {} again"
    fill = lambda x: frame.format(x, *[word() for _ in range(4)])
    items = [(i, fill("quokkas" if i < 3 else "wombats" if i < 7 else word())) for i in range(30)]
    more = [(1000 + i, " ".join(word() for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame([(1, fill(word())), (2, fill("quokkas"))], "doc_id bigint, text string")

    def copies(rows, **options):
        found = leakage.find_leaks(docs, spark.createDataFrame(rows, "item_id bigint, text string"), reparameterised=True, **options)
        return {tuple(r) for r in found.where("kind = 'reparameterised' and item_id < 1000").collect()}

    alone = copies(items)
    assert {(d, i) for d, i, *_ in alone} >= {(1, 0), (2, 0), (2, 20)}
    assert alone == copies(items + more) == copies(items, block=7)


def test_passage_against_all_alignments():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    for _ in range(40):
        item = [rng.randrange(50) for _ in range(20)]
        text = [w if rng.random() > 0.08 else rng.randrange(50) for w in item]
        if rng.random() < 0.5:
            del text[rng.randrange(len(text))]
        i = next((i for i in range(len(item) - 3) if item[i : i + 3] == text[i : i + 3]), None)
        if i is None:
            continue
        found = leakage.passage(np.array(item, np.uint64), np.array(text, np.uint64), i, i, 10, 10)
        if found:
            best = max((b - a for a in range(len(item)) for b in range(a + 10, len(item) + 1) if min(distance(item[a:b], text[c:d]) for c in range(len(text)) for d in range(c + 1, len(text) + 1)) * 10 <= b - a), default=0) if len(item) <= 12 else len(item)
            assert found[0] <= best and found[1] * 10 <= found[0]


# 9: pieces
def test_pieces(spark):
    rng = random.Random(10)
    docs = [(i, "\n".join(" ".join(rng.choices(EN + DE, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30)))) for i in range(20)]
    docs += [(50, None), (51, ""), (52, "x" * 6000), (53, "漢字" * 900), (54, "short"), (55, "word " * 700), (56, "Abstract\nA b c.\n\nClaims\n" + "".join(f"{i}. A device as claimed in claim {i - 1}, in which the seat guides the arm.\n" for i in range(1, 60)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    tok, texts = tokenizer(rank_file()), dict(docs)
    pieces = splitting.split_documents(df, limit=128, overlap=16).toPandas().sort_values(["doc_id", "piece_no"])
    assert set(pieces.doc_id) == set(texts)
    for doc, rows in pieces.groupby("doc_id"):
        text = texts[doc]
        if not text:
            assert len(rows) == 1
            continue
        end = 0
        for k, r in enumerate(rows.itertuples()):
            assert r.piece == text[r.start : r.start + r.length] and tok.count(r.piece) == r.n_tokens <= 128
            assert r.start <= end < r.start + r.length or (k == 0 and r.start == 0)
            if k and doc not in (52, 53):
                assert r.overlap_tokens >= 16
            end = r.start + r.length
        assert end == len(text)
    assert "claim" in set(pieces[pieces.doc_id == 56].cut) and splitting.split_documents(df.limit(0)).count() == 0


def test_tokens_by_line_are_those_of_the_text():
    tok, rng = tokenizer(rank_file()), random.Random(11)
    for _ in range(300):
        t = "".join(rng.choice(["ab", "C", " ", "  ", "\n", "\n\n", "\r\n", "\t", "1", ".", "é", "'s"]) for _ in range(rng.randint(1, 40)))
        assert tok.encode(t).tolist() == tok.encoding.encode_ordinary(t)


def test_marks_in_any_order():
    for text in ("a\u0302\u0323", "a\u0323\u0302", "か\u3099", "q\u0323\u0307", "e\u0327\u0301x", "u\u0308\u0304", "ﾊﾟ", "ｶﾞ"):
        new, flags = textform.canonical_array(pa.array([text, "plain"]))
        assert new.to_pylist() == [unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text)), "plain"] and flags.tolist() == [text != new[0].as_py(), False], ascii(text)
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice(["a", "o", "s", " ", "\u0301", "\u0302", "\u0323", "\u0327", "\u0308"]) for _ in range(12))
        assert textform.canonical_array(pa.array([text]))[0].to_pylist() == [unicodedata.normalize("NFC", text)], ascii(text)


def test_question_marks_of_addresses(repairer):
    for clean in ("see https://site.org/page?id=3 for it", "the page?id=3&x=1 of it", "www.site.org/is?it", "is it? yes"):
        assert not check(repairer, clean)[0], clean
    assert check(repairer, "Die L?ngsachse und https://a.b/c?d=1")[::2] == (True, False)


def test_words_with_sharp_s():
    key = lambda t: leakage.words(pa.array([t]))[0].tolist()
    assert key("straße maß") == key("STRASSE MASS") == key("STRAẞE, Maß") and key("strase") != key("straße")
    long = "a" * 5000
    assert key(long + "bc") != key(long + "cb")


def test_shares_of_any_corpus():
    shares = language.training_shares({"en": 10**10, "ru": 10}, 2 * 10**10, 6 * 10**11, 20_000)
    assert 0 < shares["en"] < 1e-6 and shares["en"] * 3 * 10**11 > 2_000 and shares["ru"] == 1.0
    assert language.training_shares({}, 0, 0, 20_000) == {}


def test_cohesion_against_dense_counts():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m = int(rng.integers(1, 25)), int(rng.integers(0, 200))
        content, terms = np.sort(rng.integers(0, 300, m)), rng.integers(0, 12, m)
        cut = np.sort(rng.choice(300, n, replace=False))
        unit = np.searchsorted(cut, content, side="right")
        counts = np.zeros((n + 1, 12))
        np.add.at(counts, (unit, terms), 1)
        sims = []
        for i in range(n):
            a, b = counts[max(0, i - 3) : i + 1].sum(axis=0), counts[i + 1 : i + 5].sum(axis=0)
            sims.append(a @ b / np.sqrt(a @ a * (b @ b)) if a.any() and b.any() else 0.0)
        sims = np.array(sims)
        up = lambda s: splitting._climb(s)
        assert np.allclose(splitting.valley_depths(terms, content, cut), up(sims) + up(sims[::-1])[::-1] - 2 * sims)


def test_statistics_against_plain_counts():
    texts = ["", None, "x" * 40_000, 'He said: "It is not a list."\nAnd 12 of them!', "a.\n\nb!\" \n c)] ", " \n ", "«Ja.»", "1 2 3"]
    chars, words, lines, lang, table = quality.text_statistics(pa.array(texts))
    plain = [t or "" for t in texts]
    assert chars.tolist() == [len(t) for t in plain] and words.tolist() == [len(t.split()) for t in plain]
    assert lines.tolist() == [sum(bool(x.strip()) for x in t.split("\n")) for t in plain]
    ended = [0, 0, 0, 2, 2, 0, 1, 0]
    assert np.allclose(table[:, 3] * lines, ended) and lang[3] == 0 and lang[2] == -1
    assert np.allclose(table[:, 1] * words, [sum(map(len, t.split())) for t in plain])
