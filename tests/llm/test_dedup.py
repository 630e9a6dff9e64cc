from tabulens.llm import dedup

PASSAGE = ("The shared passage begins here with a number of words that nobody else would write, and goes on for a while."
           " It has a second sentence that is long enough to be a unit of its own. Short end.")


def brute(rows, min_words):
    """Places that go, from all units of all rows in (doc_id, mark, position) order."""
    seen, gone = {}, {}
    marked = sorted({(i, dedup.text_mark(t or ""), t or "") for i, t in rows})
    for i, mark, text in marked:
        for pos, (a, b, n) in enumerate(dedup.units(text, min_words)):
            if n >= min_words:
                key = dedup.digest(text[a:b])
                if key in seen and seen[key] != (i, mark, pos):
                    gone.setdefault((i, mark), set()).add(pos)
                seen.setdefault(key, (i, mark, pos))
    return gone


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, removed string, n long")
    return dedup.remove_repeats(df)


def test_agrees_with_brute_force_and_offsets_name_the_original(spark):
    rows = [(1, f"first words of it\n{PASSAGE}\nand a tail of the text"), (2, f"words run into {PASSAGE} and go on here"),
            (3, f"{PASSAGE.lower()}"), (4, "nothing here is shared with any other text at all, really nothing"),
            (5, "one line that stands twice in a single text\n" * 2), (6, None), (7, ""), (8, "a"),
            (9, f"other {PASSAGE}"), (9, f"another {PASSAGE}"), (4, "nothing here is shared with any other text at all, really nothing")]
    out = run(spark, rows)
    assert out.columns == ["doc_id", "text", "n", "n_removed", "removed"]
    gone, texts = brute(rows, dedup.MIN_WORDS), {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r)
    for i, text in dict(rows).items():
        if i == 9:
            continue
        want, spans = dedup.cut(text or "", gone.get((i, dedup.text_mark(text or "")), set()), dedup.MIN_WORDS)
        for r in texts[i]:
            assert (r["text"] or "") == want and [s.asDict() for s in r["removed"]] == spans
            kept, at = "", 0
            for s in r["removed"]:
                kept, at = kept + text[at:s["start"]], s["end"]
            assert text is None or kept + text[at:] == r["text"]
    assert texts[1][0]["n_removed"] == 0 and "shared passage" not in texts[2][0]["text"]
    assert texts[5][0]["text"].count("one line") == 1
    assert len(texts[4]) == 2 and all(r["n_removed"] == 0 for r in texts[4])
    assert texts[6][0]["text"] is None and texts[7][0]["text"] == ""


def test_a_passage_in_running_text_has_the_same_units(spark):
    alone = {PASSAGE[a:b] for a, b, _ in dedup.units(PASSAGE)}
    inside = f"some words and then {PASSAGE}"
    assert alone <= {inside[a:b] for a, b, _ in dedup.units(inside)}


def test_units_cover_all_words_in_order():
    text = "A b. C d e!  \n\n  x y z Q r s, t u v w x y z a b c d e f. \tg h\n" + "word " * 30_000
    found = dedup.units(text)
    assert [a for a, *_ in found] == sorted(a for a, *_ in found)
    assert " ".join(text[a:b] for a, b, _ in found).split() == text.split()
    assert sum(n for *_, n in found) == len(text.split())


def test_hot_line_stays_once_and_empty_table(spark):
    line = "this very common line has more than eight words in it"
    out = run(spark, [(i, f"{line}\nown text {i}") for i in range(300)])
    assert sorted(r["doc_id"] for r in out.collect() if line in r["text"]) == [0]
    assert run(spark, []).count() == 0


def test_extra_columns_of_any_name(spark):
    names = ["_gone", "_gone_id", "_gone_mark", "gone", "mark", "gone____________"]
    rows = [(i, f"{PASSAGE}\nown text {i}", *range(len(names))) for i in range(3)]
    out = dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)))
    got = sorted(out.collect())
    assert out.columns == ["doc_id", "text", *names, "n_removed", "removed"]
    assert [r["n_removed"] > 0 for r in got] == [False, True, True] and all(tuple(r[2:8]) == tuple(range(6)) for r in got)
