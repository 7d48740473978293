"""Several values in one field, against a character-by-character reader."""

import random

from pyspark.sql import functions as F

from quire.operators.multivalue import labelled_lines, packed_values, split_values


def values_of(spark, texts, kind="other"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(split_values(F.col("t"), kind)).collect()]


def test_kinds(spark):
    cases = {
        "class": [("Y17V 33/92 / Q77K 3/50", ["Y17V 33/92", "Q77K 3/50"]), ("Z23T 1/94 | | X88T 31/16", ["Z23T 1/94", "X88T 31/16"]), ('"X67V 36/55"/Y33W 4/47', ["X67V 36/55", "Y33W 4/47"])],
        "other": [
            ("217/210'/232", ["217", "210'", "232"]), ("109'  98b  243'", ["109'", "98b", "243'"]), ('"172", 209, 260\', 22', ["172", "209", "260'", "22"]), ("'guide|membrane'    cable coil,\"the \"\"valve\"\", cover / conveyor\"; membrane shaft", ["guide|membrane", "cable coil", 'the "valve", cover / conveyor', "membrane shaft"]),
            ("spring-body", ["spring-body"]), ("291; 189 · 116',41\n159;", ["291", "189", "116'", "41", "159"]), ("", []), (" ; ,", []), ("a\tb\n\nc", ["a", "b", "c"]), ("multispace+tab", ["multispace", "tab"]),
        ],
    }
    for kind, rows in cases.items():
        assert values_of(spark, [t for t, _ in rows], kind) == [v for _, v in rows]


def reader(text, kind):
    """One character at a time."""
    out, word, i, fresh = [], "", 0, True

    def close(w):
        if w.strip():
            out.append(w.strip())

    while i < len(text):
        c = text[i]
        if fresh and c in "\"'" and not word.strip():
            j, body = i + 1, ""
            while j < len(text):
                if text[j] == c and text[j + 1 : j + 2] == c:
                    body, j = body + c, j + 2
                elif text[j] == c:
                    break
                else:
                    body, j = body + text[j], j + 1
            if j < len(text):
                out.append(body)
                i, word = j + 1, ""
                continue
        wide = c == " " and text[i + 1 : i + 2] == " "
        slash = c == "/" and not (kind == "class" and text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit())
        if c in ",;|·\t\n" or slash or wide:
            close(word)
            word, fresh = "", True
        else:
            word += c
            fresh = fresh and c == " "
        i += 1
    close(word)
    return out


def test_against_reader(spark):
    rng = random.Random(4)
    words = {"class": ["X15L 35/77", "Y11V 12/79", "Q03K 1/05"], "other": ["lens holder", "sleeve", "valve-seat", "12a", "209"]}
    for kind, plain in words.items():
        texts = []
        for _ in range(300):
            sep = rng.choice([", ", ";", " | ", " / ", "\t", "\n", "    ", " · "])
            items = [rng.choice(plain) if rng.random() < 0.7 else '"' + rng.choice(["a, b", 'the ""x"", y', "p | q", "r / s"]) + '"' for _ in range(rng.randint(1, 6))]
            texts.append(sep.join(items) + rng.choice(["", ";", ""]))
        assert values_of(spark, texts, kind) == [reader(t, kind) for t in texts]


def test_tables_and_lines(spark):
    elements = spark.createDataFrame(
        [(1, "t1", ([["Keywords", "Part"], ["a b; c", "x; y"], [None, "z"]], "tab\tpipe", True), "extra"), (1, "t1", ([["Keywords", "Part"], ["a b; c", "x; y"], [None, "z"]], "tab\tpipe", True), "extra"), (2, "t2", ([["Keywords"], ["a; b"]], None, False), "e"), (3, "t3", None, "e")],
        "doc_id bigint, element_id string, table_data struct<cell_rows:array<array<string>>,source_format:string,header_row:boolean>, values string",
    )
    blocks = spark.createDataFrame([(1, "b1", "Intro\r\nKEYWORDS: a; b\r\nKeywords Part"), (2, "b2", None), (3, "b3", "Stichwörter = x"), (4, "b4", "")], "doc_id bigint, block_id string, raw_text string")
    got = {tuple(r) for r in packed_values(blocks, elements).collect()}
    assert got == {
        ("cell_rows", 1, "t1", 1, 0, 0, "a b"), ("cell_rows", 1, "t1", 1, 0, 1, "c"), ("source_format", 1, "t1", 0, 0, 0, "tab"), ("source_format", 1, "t1", 0, 0, 1, "pipe"),
        ("raw_text", 1, "b1", 1, 0, 0, "a"), ("raw_text", 1, "b1", 1, 0, 1, "b"),
    }
    assert packed_values(blocks.limit(0), elements.limit(0)).count() == 0
    assert labelled_lines(blocks).count() == 2


def test_marks_in_texts(spark):
    texts = {"bolt\ue000 3, nut, washer": ["bolt\ue000 3", "nut", "washer"], "a\uffff1b, c\uffff": ["a\uffff1b", "c\uffff"], "\"it''s\", 'a\"\"b', x": ["it''s", 'a""b', "x"], "'it''s'; y": ["it's", "y"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", split_values(F.col("t")).alias("v")).collect()} == texts
