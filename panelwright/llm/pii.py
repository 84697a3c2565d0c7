"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.arrays import sums_before

CONTEXT_CHARS = 48  # characters before a span that are searched for context words
KEEP_SCORE = 0.6  # spans of added kinds need this score; base kinds are always kept

_EMAIL_CHARS = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``pattern`` finds the same leftmost matches as the plain form of the kind, but cannot
    run twice over the same characters: possessive runs never backtrack, and a look-behind
    starts them at their first character only (or where the last match ended). Most texts skip
    it: every confirmed match holds one of the ``hints`` and a match of ``likely``, if there
    are any, and a digit with ``digits``. With ``whole`` the
    pattern finds only places, and ``whole`` of its first group is the value there or null; so
    a failed or too long try at one place never hides a value that starts at the next.
    """

    name: str
    pattern: str
    hints: tuple[str, ...]
    confirm: Callable[[Column], Column]
    base_score: float | Callable[[Column], Column]
    context: str
    base: bool = True
    whole: Callable[[Column], Column] | None = None
    likely: str | None = None
    digits: bool = True


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(code: Column) -> Column:
    """True for an account code whose rearranged number leaves 1 on division by 97."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(
            c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97
        ).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(bare).between(15, 34) & (rest == 1)


# Characters of an account code by country; other countries may have any length.
CODE_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_CODE = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"


def _account(window: Column) -> Column:
    """The account code that starts a window (a run of ``_CODE`` and the next character), or null.

    It ends where no letter or digit follows, passes mod-97 and has the length of its
    country; of an unlisted country the longest such code is taken.
    """

    def parts(window):
        country = F.substring(window, 1, 2)
        lengths = [F.when(country.isin(names.split()), n) for n, names in CODE_LENGTHS.items()]
        return F.struct(
            window.alias("window"),
            F.regexp_extract(window, f"^{_CODE}", 0).alias("run"),
            F.coalesce(*lengths).alias("wanted"),
        )

    def ends(w, e):
        code = F.substring(w["run"], F.lit(1), e)
        size = F.length(F.replace(code, F.lit(" "), F.lit("")))
        return (
            (F.substring(w["run"], e, F.lit(1)) != " ")
            & ~F.substring(w["window"], e + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            & (size == F.coalesce(w["wanted"], size))
            & mod97(code)
        )

    def longest(w):
        sizes = F.sequence(F.lit(15), F.greatest(F.length(w["run"]), F.lit(15)))
        end = F.array_max(F.filter(sizes, lambda e: (e <= F.length(w["run"])) & ends(w, e)))
        return F.substring(w["run"], F.lit(1), end)

    return F.transform(F.transform(F.array(window), parts), longest)[0]


def _account_score(code: Column) -> Column:
    """A known length next to mod-97 decides alone; codes of unlisted countries need context."""
    listed = [name for names in CODE_LENGTHS.values() for name in names.split()]
    return F.when(F.substring(code, 1, 2).isin(listed), 0.6).otherwise(0.5)


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _address(value: Column) -> Column:
    def small(part):
        digits = F.regexp_replace(part, "^0+", "")
        return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _social(value: Column) -> Column:
    """Number of three, two and four digits in the ranges that are given out."""
    area, group, serial = (F.substring(value, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    return (
        value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    )


# Published forms of access keys.
ACCESS_KEY = "A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}"
# A name that announces a secret, the sign between, and the secret.
SECRET_NAME = (
    "(?:[Pp]assword|PASSWORD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)"
)
SECRET_SIGN = r"[\"']?[\x20\t]*[:=][\x20\t]*[\"']?"
SECRET_VALUE = "[A-Za-z0-9+/_.-]+={0,2}"
SECRET_SIZE = 16


def _secret(value: Column) -> Column:
    """Whether the value of an assignment is long and mixes letters and digits."""
    bare = F.regexp_extract(value, f"{SECRET_VALUE}$", 0)
    return (F.length(bare) >= SECRET_SIZE) & bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")


KINDS = (
    Kind(
        "email",
        rf"(?:(?<!{_EMAIL_CHARS})|\G){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        ("@",), lambda v: F.lit(True), 0.8, r"mail|contact|write|@", digits=False,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", (".",), _address, 0.6,
        r"(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server",
        likely=r"[0-9](?:\.[0-9]++){3}",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", (), _card, 0.7, r"card|visa|credit|payment",
        likely=r"[0-9](?:[\x20-]?[0-9]){11}",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",),
        lambda v: F.length(_digits(v)).between(9, 15), 0.6, r"phone|tel|call|mobile|fax", likely=r"\+[0-9]",
    ),
    Kind(
        "iban", rf"(?<![A-Za-z0-9])(?=({_CODE}[A-Za-z0-9\x20]?))[A-Z]{{2}}[0-9]{{2}}", (),
        lambda v: F.lit(True), _account_score, r"iban|account|bank|konto|compte|cuenta", base=False, whole=_account,
        likely=_CODE,
    ),
    Kind(
        "social", r"(?<![0-9])[0-9]++(?:-[0-9]++)++", ("-",), _social, 0.5, r"ssn|social", base=False,
        likely="[0-9]{3}-[0-9]{2}-[0-9]{4}",
    ),
    Kind(
        "access_key", r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]++|gh[pousr]_[A-Za-z0-9]++)(?![A-Za-z0-9_])", ("IA", "_"),
        lambda v: v.rlike(f"^(?:{ACCESS_KEY})$"), 0.8, r"key|token|aws|github", base=False,
        likely="A[KS]IA[A-Z0-9]{16}|gh[pousr]_", digits=False,
    ),
    Kind(
        "secret", rf"{SECRET_NAME}{SECRET_SIGN}{SECRET_VALUE}", (":", "="), _secret, 0.7,
        r"key|login|credential|config", base=False, likely=rf"{SECRET_NAME}{SECRET_SIGN}[A-Za-z0-9+/_.-]",
    ),
)


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _possible(text: str, digits: str, kind: Kind) -> Column:
    """Whether a text may hold a confirmed match; the cheaper tests stand first."""
    tests = [F.col(digits)] * kind.digits
    tests += [reduce(or_, [F.col(text).contains(hint) for hint in kind.hints])] if kind.hints else []
    tests += [F.col(text).rlike(kind.likely)] if kind.likely else []
    return reduce(and_, tests, F.lit(True))


def _proposals(text: str, digits: str, kind: Kind) -> Column:
    """(matches, the pieces between them, windows of ``whole``) of one kind; null where it is not possible."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"),
        F.split(text, kind.pattern, -1).alias("pieces"),
        *[F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)).alias("windows")] * bool(kind.whole),
    )
    return F.when(_possible(text, digits, kind), found)


def _spans(found: str, text: str, rank: int, kind: Kind) -> Column:
    matches, pieces = F.col(f"{found}.matches"), F.col(f"{found}.pieces")
    lengths = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m)
    )
    placed = F.zip_with(
        F.zip_with(sums_before(lengths), pieces, lambda s, p: s + F.length(p)),
        F.transform(F.col(f"{found}.windows"), kind.whole) if kind.whole else matches,
        lambda s, m: F.struct(s.alias("start"), m.alias("value")),
    )
    confirmed = F.filter(
        placed,
        lambda x: F.when(x["value"].isNotNull(), kind.confirm(x["value"])).otherwise(False),
    )

    score = kind.base_score
    alone = score if callable(score) else lambda value: F.lit(score)

    def scored(x):
        before = F.lower(
            F.substring(
                F.col(text),
                F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1,
                F.least(x["start"], F.lit(CONTEXT_CHARS)),
            )
        )
        return F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (x["start"] + F.length(x["value"])).alias("end"),
            (alone(x["value"]) + F.when(before.rlike(kind.context), 0.2).otherwise(0.0)).alias(
                "score"
            ),
        )

    spans = F.transform(confirmed, scored).cast(_SPAN)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP_SCORE)
    return F.coalesce(spans, F.array().cast(_SPAN))


def personal_data(
    docs: DataFrame,
    kinds: tuple[Kind, ...] = KINDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All confirmed spans of personal data of every whole text, with scores.

    One narrow pass of Spark columns: the matches of a pattern and the pieces between them
    give code-point offsets by running sums; ranges and checksums (Luhn, mod-97) confirm a
    match or drop it without another try, but account codes are tried at every place where
    one can start and at every end that the length of their country allows; a context word
    within ``CONTEXT_CHARS`` characters before it raises its score by 0.2. Spans of base
    kinds stay whatever their score, others need ``KEEP_SCORE``: mod-97 with the length of a listed country
    or the form of an access key reaches it alone, account codes of other countries and social
    numbers need a context word. The span of a
    secret is its whole assignment, name included. Spans may overlap each other.

    Result: the id column and ``spans``, an array of (start, rank, kind, end, score) sorted
    by start and then by the order of the kinds; ends are exclusive. A null or empty text
    has an empty array; a null id stays null; repeated rows are searched each; an empty
    table gives an empty result. Other columns are ignored, so their names cannot clash.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumn("digits", F.col("text").rlike("[0-9]"))
    found = rows.select(
        "id", "text", *[_proposals("text", "digits", k).alias(f"found{i}") for i, k in enumerate(kinds)]
    )
    parts = [_spans(f"found{i}", "text", i, k) for i, k in enumerate(kinds)]
    return found.select(F.col("id").alias(id_column), F.sort_array(F.concat(*parts)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets.

    Overlapping spans become one bracket, named after the first of them.
    """
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        state,
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]),
                    F.lit("["), x["kind"], F.lit("]"),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
    )
    return F.transform(
        F.array(done), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2**31 - 1))
    )[0]


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def score_text(spans: Column) -> Column:
    """Scores of the spans in hundredths, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ","
    )
