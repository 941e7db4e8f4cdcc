"""Event codecs: digits, fixed texts, round trips, errors."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import codecs as c
from tracelake.functions.formats import bytes_text
from tracelake.operators import logs, tokens
from tracelake.plans import evolve


def one(spark, *columns):
    return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).first())


def test_digits(spark):
    assert one(spark, *c.to_digits(F.lit(64), [10, 10, 10])) == (0, 6, 4)
    assert one(spark, *c.to_digits(F.lit(1234), [10, 10, 10])) == (2, 3, 4)
    assert one(spark, *c.to_digits(F.lit(-3), [2, 10, 10, 10])) == (1, 9, 9, 7)
    assert one(spark, c.from_digits([F.lit(x) for x in (1, 9, 9, 7)], [2, 10, 10, 10])) == (-3,)
    with pytest.raises(ValueError):
        c.from_digits([F.lit(1)], [10, 10])
    with pytest.raises(ValueError):
        c.check_bases([1], 10)


def mouse(t, dx, dy, flags, data, form):
    return c.encode_mouse(F.lit(t), F.lit(dx), F.lit(dy), F.lit(flags), F.lit(data), form)


def test_texts(spark):
    e9 = 10**9
    assert one(spark, c.encode_keyboard(F.lit(e9), F.lit(65), F.lit("press")), c.encode_keyboard(F.lit(e9), F.lit(65), F.lit("press"), "interleaved")) == (
        "<EVENT_START><KEYBOARD><1><0><0><VK_65><press><EVENT_END>",
        "<EVENT_START><KEYBOARD><1><0><0><65><press><EVENT_END>",
    )
    assert one(spark, mouse(e9, 10, -5, 1, 0, "compact"), mouse(e9, 10, -5, 1, 0, "interleaved")) == (
        "<EVENT_START><MOUSE><1><0><0><SIGN_PLUS><0><0><1><0><SIGN_MINUS><0><0><0><5><MB_0><MB_0><MB_1><EVENT_END>",
        "<EVENT_START><MOUSE><1><0><0><0><1><0><19><1><9><0><5><0><0><1><EVENT_END>",
    )
    assert one(spark, mouse(12_340_000_000, 2500, -50, 0x400, 65416, "compact"), mouse(17 * e9, -3, 64, 0x400, 65416, "interleaved")) == (
        "<EVENT_START><MOUSE><2><3><4><SIGN_PLUS><1><9><9><9><SIGN_MINUS><0><0><5><0><MB_4><MB_0><MB_0><SIGN_MINUS><1><EVENT_END>",
        "<EVENT_START><MOUSE><1><0><0><1><0><19><0><9><6><7><4><4><0><0><1><9><EVENT_END>",
    )
    assert one(spark, mouse(0, 0, 0, 0x1000, 0, "compact"), mouse(0, 0, 0, 0, 120 * 20, "compact")) == (None, None)


def test_round_trip_and_rejects(spark):
    for form in ("compact", "interleaved"):
        got = one(spark, c.decode_event(mouse(10**9, -7, 1999, 0xABC, 65416, form), form))[0]
        assert (got.kind, got.dx, got.dy, got.button_flags, got.button_data) == ("MOUSE", -7, 1999, 0xABC, -120)
        bad = ["", "<EVENT_START><EVENT_END>", "<EVENT_START><KEYBOARD><1><0><0><x><press><EVENT_END>", "<EVENT_START><MOUSE><1><EVENT_END>", "text"]
        assert [r.d for r in spark.createDataFrame([(x,) for x in bad], "t string").select(c.decode_event(F.col("t"), form).alias("d")).collect()] == [None] * len(bad)


def test_vocabularies():
    assert [len(c.vocabulary(f)) for f in ("compact", "interleaved", "json")] == [291, 263, 0]
    vocab = tokens.extend_vocabulary({"a": 0}, c.vocabulary("compact"))
    assert len(set(vocab.values())) == 292 and tokens.extend_vocabulary(vocab, c.vocabulary("compact")) == vocab
    with pytest.raises(ValueError):
        tokens.require_tokens({"a": 0}, "compact")


def test_episode_decoding(spark):
    text = c.encode_keyboard(F.col("t"), F.lit(65), F.lit("press"))
    rows = spark.createDataFrame([(0, 9_900_000_000), (1, 10_100_000_000)], "i int, t bigint").select("i", text.alias("x")).orderBy("i").collect()
    df = spark.createDataFrame([("e", "junk" + "".join(r.x for r in rows) + "<EVENT_START><x><EVENT_END>")], "episode string, text string")
    assert [r.t for r in tokens.decode_episode(df).orderBy("seq").collect()] == [9_900_000_000, 10_100_000_000]


def test_log_helpers(spark):
    assert one(spark, logs.title_matches(F.lit("Notepad++"), "Notepad", True), logs.title_matches(F.lit("My Notepad App"), "notepad", False)) == (False, True)
    assert one(spark, logs.media_path(F.lit("v.mkv"), F.lit("/d/a.mcap")), logs.media_path(F.lit("v.mkv"), F.lit("/d")), logs.media_path(F.lit("/x/v.mkv"), F.lit("/d"))) == ("/d/v.mkv", "/d/v.mkv", "/x/v.mkv")
    window = spark.createDataFrame([("e", i, i, t, p) for i, (t, p) in enumerate([("key", "1"), ("window", "App"), ("key", "2"), ("window", "Other"), ("key", "3")])], "episode string, seq bigint, ts_ns bigint, topic string, payload string")
    args = (F.col("topic") == "window", F.col("payload") == "App")
    assert [r.payload for r in logs.keep_while(window, *args).orderBy("seq").collect()] == ["App", "2"]
    with pytest.raises(ValueError, match="would be removed"):
        logs.checked_sanitize(window, *args, max_removed=0.2)


def test_evolution(spark):
    steps = [evolve.Migration((0, 2), (0, 3), lambda d: d), evolve.Migration((0, 3), (0, 4, 2), lambda d: d)]
    assert [s.high for s in evolve.path(steps, "0.2.5", "0.4.2")] == [(0, 3), (0, 4, 2)] and evolve.reachable(steps, "0.2") == (0, 4, 2)
    with pytest.raises(ValueError):
        evolve.path(steps, "0.2", "0.9")
    assert one(spark, evolve.rename_field(F.lit('{"a":"1"}'), "a", "b"), evolve.curve_hex(F.lit("AP8="), "00"), evolve.curve_hex(F.lit("00ff"), "00"), evolve.curve_hex(F.lit("?"), "00")) == ('{"b":"1"}', "00ff", "00ff", "00")


def test_forms_by_name(spark):
    rows = [("keyboard", 10**9, '{"vk": 65, "event_type": "press"}'), ("other", 0, "{}"), (None, None, None)]
    events = spark.createDataFrame(rows, "topic string, ts_ns bigint, payload string")
    for name in ("Compact", "INTERLEAVED"):
        first, other, none = c.encode_rows(events, name).select("text").collect()
        assert first.text.startswith("<EVENT_START><KEYBOARD>") and other.text is None and none.text is None
    assert all(r.text.startswith("<EVENT_START>{") for r in c.encode_rows(events, "json").collect())
    with pytest.raises(ValueError):
        c.encode_rows(events, "wide")


def test_sizes_round_halves_to_even(spark):
    numbers = [0, 1023, 1024, 636_544, 638_592, 1_048_575, 45_219_840, 2**30 + 2**27, 3 * 2**37, 2**50 + 2**47, 2**50 * 8191 + 3 * 2**47]
    numbers += [(100 * i + j) * 1024 + k for i in (1, 7) for j in range(3) for k in range(0, 1024, 61)]
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]

    def plain(n):
        power = max(p for p in range(6) if p == 0 or n >= 1024**p)
        return f"{n / 1024**power:.2f} {units[power]}" if power else f"{n} B"

    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", bytes_text(F.col("n")).alias("text")).collect()
    assert {r.n: r.text for r in rows} == {n: plain(n) for n in numbers}
    assert plain(636_544) == "621.62 KiB" and plain(45_219_840) == "43.12 MiB"


def test_digits_and_decoding_stay_small(spark):
    """A digit's expression does not double from place to place; an event's tokens are tested by one match, not one by one."""
    text = lambda *columns: spark.range(1).select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    sizes = [len(text(F.concat(*[d.cast("string") for d in c.to_digits(F.col("id"), [10] * n)]))) for n in (2, 4, 8)]
    assert sizes[2] < 5 * sizes[0]
    for form in ("compact", "interleaved"):
        plan = text(c.decode_event(F.concat(F.lit("<"), F.col("id").cast("string")), form))
        assert plan.count("RLIKE") and plan.count("translate(") < 20
        assert one(spark, *c.to_digits(F.lit(-1234), [2, 20, 10, 10])) == (1, 7, 6, 6)


def test_decoding_of_odd_texts(spark):
    good = "<EVENT_START><KEYBOARD><1><0><0><VK_65><press><EVENT_END>"
    mouse_text = "<EVENT_START><MOUSE><1><0><0><SIGN_PLUS><0><0><1><0><SIGN_MINUS><0><0><0><5><MB_4><MB_0><MB_1>{}<EVENT_END>"
    kept = [good, "a>" + good.replace("><", "> \n<") + "end <open", good.replace("<1><0><0>", "<0><9><10>"), mouse_text.format(""), mouse_text.format("<SIGN_MINUS><3>"), mouse_text.format("<x><3>")]
    lost = [good + "<x>", good.replace("VK_65", "65"), good.replace("press", "hold"), good.replace("<1>", "<>"), good.replace("<1>", "<99999999999999999999>"), mouse_text.format("<SIGN_PLUS>"), mouse_text.format("").replace("MB_4", "MB_44"), mouse_text.format("").replace("SIGN_PLUS", "SIGN")]
    rows = spark.createDataFrame(list(enumerate(kept + lost)), "i int, t string").select("i", c.decode_event(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d is not None for r in rows] == [True] * len(kept) + [False] * len(lost)
    assert [(r.d.kind, r.d.ts_ns, r.d.vk, r.d.dx, r.d.dy, r.d.button_flags, r.d.button_data) for r in rows[: len(kept)]] == [
        *[("KEYBOARD", 10**9, 65, None, None, None, None)] * 3,
        *[("MOUSE", 10**9, None, 10, -5, 0x401, data) for data in (0, -360, None)],
    ]


def test_text_is_made_once(spark):
    """Rows without text are left out without making the text a second time below, in a filter."""
    events = spark.createDataFrame([("keyboard", 10**9, '{"vk": 65, "event_type": "press"}'), ("screen", 0, "{}"), ("mouse", 0, '{"button_flags": 4096}'), ("other", 0, "{}"), (None, None, None)], "topic string, ts_ns bigint, payload string")
    out = tokens.tokenize(events, tokens.extend_vocabulary({}, c.vocabulary("compact")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("<EVENT_START><SCREEN>") == 1
    assert out.columns == [*events.columns, "text", "token_ids", "total_token_count", "valid"]
    assert sorted((r.topic, r.total_token_count, r.valid) for r in out.collect()) == [("keyboard", 8, True), ("screen", 7, False)]
