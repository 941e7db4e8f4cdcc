"""Event codecs: events as token text and back, as column expressions.

Two token formats. ``compact`` writes signs as tokens of their own; ``interleaved``
writes deltas as wrapped mixed-radix digits, x and y in turn. A third, ``json``,
wraps the envelope. Fields out of range give null, which ``strict`` callers turn
into errors; deltas are clamped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.formats import div, let

START, END, IMAGE = "<EVENT_START>", "<EVENT_END>", "<fake_image_placeholder>"
TICK_NS, NOTCH = 10_000_000, 120
#: Digit bases (fixed values of the two formats): time, deltas, scroll.
COMPACT = {"time": [10, 10, 10], "delta": [10, 10, 10, 10], "limit": 1999, "scroll": [10]}
INTERLEAVED = {"time": [16, 10, 10], "delta": [2, 20, 10, 10], "limit": 1999, "scroll": [2, 10]}
TOKEN = "<[^>]*>"


def check_bases(bases: list[int], most: int) -> None:
    """Bases must be 2 to ``most``; ValueError otherwise."""
    if not bases or any(not 2 <= b <= most for b in bases):
        raise ValueError(f"bases must be between 2 and {most}: {bases}")


def to_digits(value: Column, bases: list[int]) -> list[Column]:
    """Mixed-radix digits, first the most significant; values out of range wrap as floor division makes them."""
    out, below = [], 1
    for b in reversed(bases):
        # The value stands once in each digit, so that digits of digits do not double their expressions.
        out.append(F.call_function("div", F.pmod(value.cast("long"), F.lit(below * b)), F.lit(below)))
        below *= b
    return out[::-1]


def from_digits(digits: list[Column], bases: list[int], signed: bool | None = None) -> Column:
    """The value of digits; signed (by default if the first base is 2) reads the upper half as negative."""
    if len(digits) != len(bases):
        raise ValueError(f"{len(digits)} digits for {len(bases)} bases")
    value, size = F.lit(0).cast("long"), 1
    for d, b in zip(digits, bases, strict=True):
        value, size = value * b + d.cast("long"), size * b
    signed = bases[0] == 2 if signed is None else signed
    return F.when(value >= size // 2, value - size).otherwise(value) if signed else value


def _tokens(parts: list[Column], prefix: str = "") -> Column:
    return F.concat(*[F.concat(F.lit(f"<{prefix}"), p.cast("string"), F.lit(">")) for p in parts])


def _hex3(flags: Column) -> list[Column]:
    text = F.lpad(F.lower(F.hex(flags)), 3, "0")
    return [F.substring(text, i, 1) for i in (1, 2, 3)]


def _signed16(data: Column) -> Column:
    return F.when(data >= 32768, data - 65536).otherwise(data)


def encode_time(ts_ns: Column, bases: list[int]) -> Column:
    return _tokens(to_digits(div(ts_ns, TICK_NS), bases))


def encode_keyboard(ts_ns: Column, vk: Column, event_type: Column, form: str = "compact") -> Column:
    bases, prefix = (COMPACT["time"], "VK_") if form == "compact" else (INTERLEAVED["time"], "")
    return F.concat(F.lit(f"{START}<KEYBOARD>"), encode_time(ts_ns, bases), _tokens([vk], prefix), F.concat(F.lit("<"), event_type, F.lit(f">{END}")))


def encode_mouse(ts_ns: Column, dx: Column, dy: Column, flags: Column, data: Column, form: str = "compact") -> Column:
    """Null where flags exceed 0xFFF or the scroll distance its range."""
    notches = div(_signed16(data).cast("long"), NOTCH)
    if form == "compact":
        sign = lambda v: F.when(v < 0, "<SIGN_MINUS>").otherwise("<SIGN_PLUS>")
        clamp = lambda v: F.greatest(F.least(v, F.lit(1999)), F.lit(-1999))
        moves = F.concat(*[F.concat(sign(v), _tokens(to_digits(F.abs(clamp(v)), COMPACT["delta"]))) for v in (dx, dy)])
        buttons, bases, low, high = _tokens(_hex3(flags), "MB_"), COMPACT["time"], -9, 9
        scroll = F.concat(sign(notches), _tokens(to_digits(F.abs(notches), COMPACT["scroll"])))
    else:
        clamp = lambda v: F.greatest(F.least(v, F.lit(1999)), F.lit(-2000))
        pairs = zip(to_digits(clamp(dx), INTERLEAVED["delta"]), to_digits(clamp(dy), INTERLEAVED["delta"]), strict=True)
        moves = _tokens([d for pair in pairs for d in pair])
        buttons, bases, low, high = _tokens(_hex3(flags)), INTERLEAVED["time"], -10, 9
        scroll = _tokens(to_digits(notches, INTERLEAVED["scroll"]))
    ok = flags.between(0, 0xFFF) & ((data == 0) | notches.between(low, high))
    text = F.concat(F.lit(f"{START}<MOUSE>"), encode_time(ts_ns, bases), moves, buttons, F.when(data != 0, scroll).otherwise(""), F.lit(END))
    return F.when(ok, text)


def encode_screen(ts_ns: Column, form: str = "compact") -> Column:
    bases = COMPACT["time"] if form == "compact" else INTERLEAVED["time"]
    return F.concat(F.lit(f"{START}<SCREEN>"), encode_time(ts_ns, bases), F.lit(f"{IMAGE}{END}"))


def encode_event(topic: Column, ts_ns: Column, payload: Column, form: str = "compact") -> Column:
    """Token text of an envelope row; null for topics that no encoder knows."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    # A payload is parsed once: fields taken straight from from_json would each parse their own schema.
    key, mouse = F.from_json(payload, "vk int, event_type string"), F.from_json(payload, "last_x int, last_y int, button_flags int, button_data int")
    of_mouse = lambda m: encode_mouse(ts_ns, zero(m["last_x"]), zero(m["last_y"]), zero(m["button_flags"]), zero(m["button_data"]), form)
    return (
        F.when(topic == "keyboard", let(key, lambda k: encode_keyboard(ts_ns, k["vk"], k["event_type"], form)))
        .when(topic.isin("mouse", "mouse/raw"), let(mouse, of_mouse))
        .when(topic == "screen", encode_screen(ts_ns, form))
    )


FORMS = ("compact", "interleaved", "json")


def form_named(name: str) -> str:
    """The format of a name in any case; ValueError for others."""
    form = name.strip().lower()
    if form not in FORMS:
        raise ValueError(f"no event format {name!r}; there are {', '.join(FORMS)}")
    return form


def encode_rows(events: DataFrame, name: str = "compact", *, text: str = "text") -> DataFrame:
    """``events`` with their token text by a format's name; null where the format can't express the event."""
    form = form_named(name)
    envelope = F.struct("topic", "ts_ns", "payload")
    coded = encode_json(envelope, F.col("topic")) if form == "json" else encode_event(F.col("topic"), F.col("ts_ns"), F.col("payload"), form)
    return events.withColumn(text, coded)


def encode_json(envelope: Column, topic: Column) -> Column:
    """The envelope as JSON between the marks; a screen payload becomes the image placeholder."""
    body = F.when(topic == "screen", envelope.withField("payload", F.lit(IMAGE))).otherwise(envelope)
    return F.concat(F.lit(START), F.to_json(body), F.lit(END))


def decode_json(text: Column, schema: str) -> Column:
    inner = F.regexp_extract(text, f"(?s)^{START}(.*){END}$", 1)
    return F.from_json(F.when(inner != "", inner), schema)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _inside(token: Column, prefix: str, allowed: str) -> Column:
    """What a token ``<prefix...>`` holds after its prefix; null if that is empty or has other characters."""
    n = len(prefix) + 1
    text = F.substring(token, F.lit(n + 1), F.length(token) - (n + 1))
    return F.when(token.startswith(f"<{prefix}") & token.endswith(">") & (text != "") & (F.translate(text, allowed, "") == ""), text)


def _number(token: Column, prefix: str = "") -> Column:
    return _inside(token, prefix, "0123456789").try_cast("long")


def _named(name: str) -> str:
    """A pattern of the token of a name; stray opening marks inside it count for nothing."""
    return "<<*" + "<*".join(name) + "<*>"


def _shape(kind: str, *body: str, form: str = "compact") -> str:
    """A pattern of whole texts whose tokens are an event's; between tokens, and where a last one stays open, other text may stand."""
    times = ["<[0-9]+>"] * len((COMPACT if form == "compact" else INTERLEAVED)["time"])
    return "\\A[^<]*" + "[^<]*".join([START, _named(kind), *times, *body, END]) + "[^<]*(?:<[^>]*)?\\z"


def decode_event(text: Column, form: str = "compact") -> Column:
    """struct<kind, ts_ns, vk, event_type, dx, dy, button_flags, button_data>; null where the text is no event of the form."""
    compact, digit = form == "compact", "<[0-9]+>"
    vk, button, signed = ("<VK_[0-9]+>", "<MB_[0-9a-f]>", ["<SIGN_(?:PLUS|MINUS)>", *[digit] * 4]) if compact else (digit, "<[0-9a-f]>", [digit] * 4)
    # One match tells that all tokens are of their kinds, so that none needs a test of its own.
    keyboard = text.rlike(_shape("KEYBOARD", vk, f"(?:{_named('press')}|{_named('release')})", form=form))
    mouse = text.rlike(_shape("MOUSE", *signed, *signed, *[button] * 3, "(?:<[^>]*>[^<]*<[^>]*>[^<]*)?", form=form))
    screen = text.rlike(_shape("SCREEN", IMAGE, form=form))
    return F.when(keyboard, let(tokens(text), lambda t: _keyboard(t, form))).when(mouse, let(tokens(text), lambda t: _mouse(t, form))).when(screen, let(tokens(text), lambda t: _screen(t, form)))


def _digit(t: Column, i: int, skip: int = 1) -> Column:
    """The number in the i-th token, of which ``skip`` characters stand before it."""
    token = F.get(t, F.lit(i))
    return F.substring(token, F.lit(skip + 1), F.length(token) - (skip + 1)).try_cast("long")


def _event(kind: str, t: Column, form: str, **fields: Column) -> Column:
    """An event's struct; null where its time or a number that it needs is too large."""
    bases = (COMPACT if form == "compact" else INTERLEAVED)["time"]
    ts = from_digits([_digit(t, 2 + i) for i in range(len(bases))], bases, signed=False) * TICK_NS
    types = (("vk", "int"), ("event_type", "string"), ("dx", "int"), ("dy", "int"), ("button_flags", "int"), ("button_data", "int"))
    out = F.struct(F.lit(kind).alias("kind"), ts.alias("ts_ns"), *[fields.get(k, F.lit(None)).cast(c).alias(k) for k, c in types])
    return let(out, lambda v: F.when(v["ts_ns"].isNotNull() & F.concat(*[v[k].cast("string") for k in ("vk", "dx", "dy") if k in fields] or [F.lit("")]).isNotNull(), v))


def _keyboard(t: Column, form: str) -> Column:
    body = 2 + len((COMPACT if form == "compact" else INTERLEAVED)["time"])
    return _event("KEYBOARD", t, form, vk=_digit(t, body, 4 if form == "compact" else 1), event_type=F.translate(F.get(t, F.lit(body + 1)), "<>", ""))


def _mouse(t: Column, form: str) -> Column:
    at = lambda i: F.get(t, F.lit(i))
    sign = lambda i: F.when(at(i) == "<SIGN_PLUS>", 1).when(at(i) == "<SIGN_MINUS>", -1)
    if form == "compact":
        body = 2 + len(COMPACT["time"])
        dx, dy = (sign(i) * from_digits([_digit(t, i + 1 + j) for j in range(4)], COMPACT["delta"], signed=False) for i in (body, body + 5))
        flags_at, scroll_at, skip = body + 10, body + 13, 5
        scroll = sign(scroll_at) * _number(at(scroll_at + 1))
    else:
        body = 2 + len(INTERLEAVED["time"])
        dx, dy = (from_digits([_digit(t, body + 2 * j + k) for j in range(4)], INTERLEAVED["delta"]) for k in (0, 1))
        flags_at, scroll_at, skip = body + 8, body + 11, 2
        scroll = from_digits([_number(at(scroll_at + j)) for j in range(2)], INTERLEAVED["scroll"])
    flags = F.conv(F.concat(*[F.substring(at(flags_at + i), skip, 1) for i in range(3)]), 16, 10)
    return _event("MOUSE", t, form, dx=dx, dy=dy, button_flags=flags, button_data=F.when(F.size(t) > scroll_at + 1, scroll * NOTCH).otherwise(0))


def _screen(t: Column, form: str) -> Column:
    return _event("SCREEN", t, form)


def vocabulary(form: str) -> list[str]:
    """All tokens of a format, sorted."""
    common = [START, END, "<KEYBOARD>", "<MOUSE>", "<SCREEN>", "<press>", "<release>"]
    if form == "compact":
        signs = ["<SIGN_PLUS>", "<SIGN_MINUS>"]
        return sorted([*common, *signs, *(f"<VK_{i}>" for i in range(256)), *(f"<MB_{i:x}>" for i in range(16)), *(f"<{i}>" for i in range(10))])
    return sorted([*common, *(f"<{i}>" for i in range(256))]) if form == "interleaved" else []
