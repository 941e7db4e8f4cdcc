"""Line and paragraph hashing against a plain walk over the units."""

import random
import re

import xxhash

from tracelake.llm.queries import op5_unit_dedup
from tracelake.llm.unit_dedup import LONG, repeated_units, substring_dedup, units


def lowered(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def plain_units(text):
    """(words, start, end) of each unit, by plain loops: lines, joined where short, cut at words of least digest where long."""
    lines, at = [], 0
    for line in (text or "").split("\n"):
        words = [(lowered(m.group()), at + m.start(), at + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        at += len(line) + 1
        if words:
            lines.append(words)
    merged, was_short = [], False
    for words in lines:
        if was_short and len(words) < 6:
            merged[-1] = merged[-1] + words
        else:
            merged.append(words)
        was_short = len(words) < 6
    out = []
    for words in merged:
        cuts = [0]
        if len(words) > 24:
            digest = [xxhash.xxh3_64_intdigest(w.encode()) for w, *_ in words]
            for i in range(5, len(words) - 5):
                if digest[i] < min(digest[i - 5 : i]) and digest[i] <= min(digest[i + 1 : i + 6]):
                    cuts.append(i + 1)
        for i, j in zip(cuts, [*cuts[1:], len(words)], strict=True):
            out.append((tuple(w for w, *_ in words[i:j]), words[i][1], words[j - 1][2]))
    return out


def walked(rows, min_run=25):
    """Rows (id, start, end, first id, first start) of every unit that occurs earlier, in a long enough run of such units or a text of no others."""
    first, out = {}, []
    for k, text in sorted((k, t) for k, t in rows if k is not None and t is not None):
        found, runs = plain_units(text), [[]]
        for words, start, end in found:
            origin = first.setdefault(words, (k, start))
            if origin < (k, start):
                runs[-1].append((k, start, end, *origin, len(words) if len(words) >= 6 else 0))
            else:
                runs.append([])
        whole = len(runs) == 1
        out += [x[:-1] for run in runs if whole or sum(x[-1] for x in run) >= min_run for x in run]
    return sorted(out)


def test_query_equals_walk(spark, sf_dir, texts):
    got = sorted(map(tuple, op5_unit_dedup(spark, sf_dir).select("doc_id", "start", "end", "first_doc_id", "first_start").collect()))
    assert got == walked(texts.items()) and got


def test_units_cover_texts(texts):
    for text in list(texts.values())[:50]:
        found = units(text or "", 1)
        words = (text or "").encode().lower().split()
        assert sum(len(text[s:e].encode().split()) for _, s, e, *_ in found) == len(words) == sum(x[4] for x in found)
        assert {x[5] for x in found} <= {len(found)}
        assert [x[3] for x in found] == list(range(len(found)))


def test_short_lines_are_one_paragraph(spark):
    """A passage set in lines of two words is found, also where its lines break elsewhere or nowhere."""
    words = [f"v{i}" for i in range(60)]
    lines = lambda n: "\n".join(" ".join(words[i : i + n]) for i in range(0, 60, n))
    rows = [(1, f"an own line of some eight words here\n{lines(2)}"), (2, f"{lines(3)}\nanother line of eight words in this text"), (3, lines(60))]
    gone = {r.doc_id: r.text for r in substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert gone[1] == rows[0][1] and len(gone[2].split()) < 20 and len(gone[3].split()) < 20


def test_shared_sentences_stay(spark):
    """Repeated units that add up to fewer than min_run words in a row stay."""
    rows = [(i, f"this is number {i} of some texts\none short sentence that all of them share\nand another end {i} of the text") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert repeated_units(docs).count() == 0 and repeated_units(docs, min_run=8).count() == 4


def test_whole_copies_go(spark):
    """Copies go to the last word: with short lines between, in few words, in one; what only resembles them stays."""
    line = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    mixed = "\n".join(x for i in range(20) for x in (line(i), f"only three words{i}"))
    rows = [(1, mixed), (2, mixed), (3, " ".join(f"a{i}" for i in range(24))), (4, "two words"), (5, "Once"), (6, rows_end := "Once\nmore of it here"), (7, "a text of its own\nOnce")]
    rows += [(i + 10, t) for i, t in rows if i in (3, 4, 5, 6)]
    out = {r.doc_id: r.text for r in substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k for k, t in out.items() if not t.split()} == {2, 13, 14, 15, 16}
    assert out[1] == mixed and out[6] == rows_end and out[7] == rows[6][1]


def test_no_copy_of_the_table_is_left(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    first = {}
    copies = [k for k in sorted(texts) if first.setdefault(texts[k], k) != k and (texts[k] or "").strip()]
    out = {r.doc_id: r.text for r in substring_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert copies and not any(out[k].strip() for k in copies)


def test_normalised_and_in_code_points(spark):
    rows = [(1, "é Eins zwei drei vier fünf  sechs"), (2, "x\n É nein\n\té  EINS zwei drei vier fünf sechs \nrest"), (3, "é eins zwei drei vier fünf sechs")]
    got = sorted(map(tuple, repeated_units(spark.createDataFrame(rows, "doc_id bigint, text string"), min_run=6).collect()))
    start = rows[1][1].index("é  EINS")
    assert got == [(2, start, start + len("é  EINS zwei drei vier fünf sechs"), 1, 0), (3, 0, len(rows[2][1]), 1, 0)]


def test_passages_inside_long_lines(spark):
    """A passage of over 50 words is found wherever it stands in a line; fresh text is not touched."""
    draw = random.Random(3)
    fresh = lambda n: " ".join(f"f{draw.randrange(10**9)}" for _ in range(n))
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"{fresh(30 + 7 * i)} {passage} {fresh(40)}") for i in range(20)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].removed == []
    for i, text in rows[1:]:
        gone = sum(e - s for s, e in out[i].removed)
        assert gone > 0.4 * len(passage) and len(out[i].text) == len(text) - gone
        assert all(s >= text.index(passage) and e <= text.index(passage) + len(passage) for s, e in out[i].removed)


def test_removed_offsets_restore_the_text(docs, texts):
    for r in substring_dedup(docs).collect():
        text, at, kept = texts[r.doc_id], 0, []
        for s, e in r.removed:
            kept.append((text or "")[at:s])
            at = e
        assert r.text == (None if text is None else "".join([*kept, text[at:]]))


def test_messy(messy, none):
    got = substring_dedup(messy)
    assert [c for c in got.columns if c not in ("text", "removed")] == [c for c in messy.columns if c != "text"]
    rows = got.collect()
    assert len(rows) == messy.count()
    assert sum(bool(r.removed) for r in rows if r.doc_id is None) == 0
    rows = [(r.doc_id, r.text) for r in messy.collect() if r.doc_id != 20]
    assert sorted(map(tuple, repeated_units(messy.where("doc_id <> 20")).collect())) == walked(rows)
    assert repeated_units(none).count() == 0 and substring_dedup(none).count() == 0


def test_cuts_are_local():
    words = [f"w{i}" for i in range(400)]
    a = {x[0] for x in units(" ".join(words), 1)}
    b = {x[0] for x in units(" ".join([*words[:200], "changed", *words[200:]]), 1)}
    assert len(a - b) <= 3 and len(a) > 400 / LONG
