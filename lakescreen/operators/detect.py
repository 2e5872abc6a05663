"""The detectors as one table of declarations, and one pass over the texts that runs those a scan needs.

Each declaration has a pattern, a validity rule over the hit, and what it shows. All hits of a document come from one
projection over its text and one explode; rules, snippets and first-of-a-value choices work on the few rows after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import rx
from ..plans import dims
from ..plans import patterns as P

Expr = Callable[["Hit"], Column]


class Hit:
    """An exploded hit, for rules to read."""

    def __init__(self, row: Column | dict[str, Column]):
        self.row, self.m, self.pre, self.post = row, row["m"], row["pre"], row["post"]

    def g(self, k: int) -> Column:
        return F.coalesce(F.get(self.row["g"], F.lit(k - 1)), F.lit(""))

    def compact(self, k: int = 1) -> Column:
        return F.regexp_replace(self.g(k), r"(?U)[\s\-]", "")


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    category: str | Expr
    keys: tuple[str, ...]
    flags: str = ""
    groups: int = 0
    languages: tuple[str, ...] | None = None
    near: tuple[str, int] | None = None
    valid: Expr | None = None
    shown: Expr | None = None
    raw: Expr | None = None
    reason: Expr | None = None
    scope: str | None = None
    key: Expr | None = None
    radius: int = 40
    more: Expr | None = None  # characters after the match that belong to it
    hits: Callable[[str], str] | None = None  # SQL of the hits in a text, of its expression
    pack: int = 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _ends(x: Column, chars: str = " \t\r\n,;:.") -> Column:
    return rx.strip(x, chars)


def _amount(x: Column) -> Column:
    return F.rtrim(rx.strip(x, " \t\r\n"), F.lit(".,"))


def bibliographic(h: Hit) -> Column:
    window = F.concat(rx.last(h.pre, 48), h.m, F.substr(h.post, F.lit(1), F.lit(48)))
    return window.rlike(rx.java(P.BIBLIOGRAPHIC, "i")) | rx.last(h.pre, 48).rlike(rx.java(P.PAGE_BEFORE, "i"))


def _phone_reason(h: Hit) -> Column:
    raw = h.m
    tight = F.replace(raw, F.lit(" "), F.lit(""))
    return (
        F.when(bibliographic(h), "bibliografisk DOI/ISBN/ISSN/sidekontekst")
        .when(tight.rlike(P.YEAR_RANGE), "årsspenn")
        .when(tight.rlike(P.ISO_DATE), "ISO-dato")
        .when(raw.rlike(r"^\d{4}-\d{4}$"), "4+4 saks-/referansenummer")
        .when(C.compact_date(F.regexp_replace(raw, r"(?U)[\s\-]", "")), "kompakt dato")
        .when(rx.last(h.pre, 40).rlike(rx.java(P.INVOICE_BEFORE, "i")), "faktura-/invoice-nummer")
    )


AXIS_REASON = "graf-/akseverdi eller tallsekvens"


def _steady(values: Column, least: Column | int) -> Column:
    """Whether numbers rise or fall by one constant step."""
    n = F.size(values)
    steps = F.array_distinct(F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: y - x))
    return (n >= least) & (F.size(steps) == 1) & (steps[0] != 0)


def on_an_axis(h: Hit, technical: Column) -> Column:
    """Whether a phone-like number is part of a regular run of numbers, as on the axis of a chart."""
    labelled = h.m.startswith("+47") | h.m.startswith("0047") | rx.last(h.pre, 30).rlike(rx.java(P.PHONE_LABEL_BEFORE, "i"))
    pre = rx.last(h.pre, 90)
    window, a = F.concat(pre, h.m, F.substr(h.post, F.lit(1), F.lit(90))), F.length(pre)
    b = a + F.length(h.m)
    kind = "array<struct<k:int,run:int,inside:boolean,value:decimal(38,0)>>"
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("run"), F.array().cast(kind).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        joined = F.substr(window, acc["end"] + 1, t["start"] - acc["end"]).rlike(rx.java(P.AXIS_SEPARATOR))
        run = acc["run"] + F.when(joined, 0).otherwise(1)
        inside = (t["end"] > a) & (t["start"] < b)
        one = F.struct(F.size(acc["out"]).alias("k"), run.alias("run"), inside.alias("inside"), t["m"].try_cast("decimal(38,0)").alias("value"))
        return F.struct(t["end"].alias("end"), run.alias("run"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

    def told(tokens: Column) -> Column:
        inside = F.filter(tokens, lambda t: t["inside"])
        first, last = inside[0], F.element_at(inside, -1)
        run = F.filter(tokens, lambda t: (t["k"] <= first["k"]) & (t["run"] == first["run"]) | (t["k"] > first["k"]) & (t["k"] < last["k"]) | (t["k"] >= last["k"]) & (t["run"] == last["run"]))
        values = lambda of: F.transform(of, lambda t: t["value"])
        charted = window.rlike(rx.java(P.CHART_WORDS, "i")) & _steady(values(inside), 4)
        return F.when(F.size(inside) > 0, _steady(values(run), F.when(technical, 4).otherwise(5)) | charted).otherwise(F.lit(False))

    # Inside a lambda the tokens are found once.
    regular = F.transform(F.array(F.aggregate(rx.offsets(window, rx.java(P.AXIS_TOKEN)), begin, step, lambda acc: acc["out"])), told)[0]
    return F.when(labelled, F.lit(False)).otherwise(F.coalesce(regular, F.lit(False)))


def phone_reason(h: Hit, technical: Column) -> Column:
    """Why a phone-like number is none; null if it may be one."""
    return F.coalesce(_phone_reason(h), F.when(on_an_axis(h, technical), AXIS_REASON))


def _card_type(d: Column) -> Column:
    n, two, four = F.length(d), F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(1), F.lit(4))
    return (
        F.when((n == 16) & d.startswith("4"), "Visa")
        .when((n == 16) & (two.between("51", "55") | four.between("2221", "2720")), "Mastercard")
        .when((n == 16) & ((two == "65") | (four == "6011")), "Discover")
        .when((n == 15) & two.isin("34", "37"), "American Express")
        .when((n == 13) & d.startswith("4"), "Visa")
    )


def iban_ok(s: Column) -> Column:
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    return F.length(s).between(14, 34) & F.substr(s, F.lit(1), F.lit(2)).isin(P.IBAN_COUNTRIES) & s.rlike("^[A-Z0-9]+$") & (C.mod97(turned) == 1)


def account_ok(digits: Column) -> Column:
    """Whether 11 digits are an account number and no birth number."""
    return C.mod11(digits, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) & C.norwegian_id(digits).isNull()


def _dni_ok(s: Column) -> Column:
    number = F.substr(s, F.lit(1), F.lit(8)).try_cast("int")
    return F.substr(F.lit(P.DNI_LETTERS), number % 23 + 1, F.lit(1)) == F.substr(s, F.lit(9), F.lit(1))


def _insee_ok(s: Column) -> Column:
    base = F.substr(s, F.lit(1), F.lit(13)).try_cast("long")
    return (F.length(s) == 15) & (97 - base % 97 == F.substr(s, F.lit(14), F.lit(2)).try_cast("long"))


def _words(words: tuple[str, ...]) -> str:
    return r"(?<!\w)(" + "|".join(map(rx.literal, words)) + r")(?!\w)"


def _in_heading(words: tuple[str, ...]) -> Callable[[str], str]:
    def found(text: str) -> str:
        heads, pattern = rx.java(P.HEADING, "m"), rx.java(_words(words), "i")
        spans = f"if({text} rlike {rx.quoted(heads)}, {rx.offsets_sql(text, heads)}, null)"
        inside = "array(cast(coalesce(exists(heads, s -> s.start <= o.start and o.start <= s.`end`), false) as string))"
        return f"if({text} rlike {rx.quoted(pattern)}, transform(array({spans}), heads -> {rx.bare_sql(text, pattern, 0, inside)})[0], {rx.NO_BARE})"

    return found


def _sums(text: str) -> str:
    rows = rx.java(P.TOTAL_ROW, "im")
    two = f"size(regexp_extract_all(o.m, {rx.quoted(rx.java(P.MONEY))}, 1)) >= 2"
    spans = f"if({text} rlike {rx.quoted(rows)}, filter({rx.offsets_sql(text, rows)}, o -> {two}), null)"
    free = "not coalesce(exists(spans, s -> s.start <= h.start and h.start < s.`end`), false)"
    return f"transform(array({spans}), spans -> filter({rx.bare_sql(text, rx.java(P.SUM_WORD, 'i'), 1)}, h -> {free}))[0]"


def _streets(text: str) -> str:
    """Hits of all address patterns in their order, less those that overlap an earlier one; by place."""
    each = "concat(" + ", ".join(rx.bare_sql(text, rx.java(p)) for p in P.STREETS) + ")"
    over = "s.start <= h.start and h.start < s.`end` or s.start < h.`end` and h.`end` <= s.`end`"
    return f"array_sort(aggregate({each}, {rx.NO_BARE}, (acc, h) -> if(exists(acc, s -> {over}), acc, concat(acc, array(h)))))"


def _tax_value(h: Hit) -> Column:
    cut = F.split(h.g(1), P.TAX_ENDS[0], 2)[0]
    return rx.squeeze(_ends(F.split(cut, rx.java(P.TAX_ENDS[1], "i"), 2)[0]))


def _birth(h: Hit) -> Column:
    return F.regexp_extract(F.substr(h.post, F.lit(1), F.lit(60)), P.DATE, 0)


def _clean_url(h: Hit) -> Column:
    return F.regexp_replace(h.m, r"[.,;:!?)]+$", "")


def _doi_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.regexp_replace(url, r"(?i)^https?://", ""), r"^([^/?#:]*)", 1))
    return (host == "doi.org") | host.endswith(".doi.org")


def _countries(spark: SparkSession | None) -> list[str]:
    """ISO 3166-1 alpha-2, as Java knows it."""
    session = spark or SparkSession.active()
    return sorted(session._jvm.java.util.Locale.getISOCountries())


NO = ("id", "klient", "konto", "telefon")
EXTRA = ("id", "konto", "nettadresse", "telefon", "adresse", "finansielt", "medisinsk", "hemmeligheter")
FIELD = lambda h: _ends(h.g(1))
SOME = lambda h: FIELD(h) != ""
HEADED = lambda h: F.when(h.g(1) == "true", "konfidensielt dokument (overskrift)").otherwise("konfidensielt dokument (brødtekst)")


def registry(spark: SparkSession | None = None) -> tuple[Detector, ...]:
    """All detectors, in the order in which their findings are told."""
    D = Detector
    en = ("en", "de", "fr", "es")
    pair = lambda h: F.concat(h.g(1), h.g(2))
    card = lambda h: h.compact()
    iban = lambda h: F.upper(F.replace(h.g(1), F.lit(" "), F.lit("")))
    pick = lambda k: lambda h: _amount(h.g(k))
    secrets = [
        D(f"secret:{cat}", p, cat, ("hemmeligheter",), groups=1, raw=lambda h: h.g(1), pack=1,
          shown=lambda h: F.concat(F.substr(h.g(1), F.lit(1), F.lit(4)), F.lit("****")),
          valid=(lambda h: (C.entropy(h.g(1)) >= 3.0) & h.g(1).rlike("[0-9]") & h.g(1).rlike("[A-Za-z]")) if cat == "høy-entropisteng" else None)
        for cat, p in P.SECRETS
    ]
    money = {"scope": "money", "radius": 55, "flags": "i"}
    return (
        D("confidential", "", HEADED, ("hemmeligheter",), radius=60, hits=_in_heading(P.CONFIDENTIAL)),
        D("confidential_phrase", "", HEADED, ("hemmeligheter",), radius=60, hits=_in_heading(P.CONTEXTUAL)),
        D("code_word", _words(P.CODE_WORDS), "konfigurasjonsord (mulig secret)", ("hemmeligheter",), flags="i", radius=60),
        *secrets,
        D("email", P.EMAIL, "e-post", ("epost",), flags="i", pack=2),
        D("url_http", P.URL_HTTP, "nettadresse", ("nettadresse",), flags="i", radius=60, shown=_clean_url, scope="url", pack=3,
          key=lambda h: F.lower(_clean_url(h)), valid=lambda h: (F.length(_clean_url(h)) >= 5) & ~_clean_url(h).contains("@") & ~_doi_host(_clean_url(h))),
        D("url_www", P.URL_WWW, "nettadresse", ("nettadresse",), flags="i", radius=60, shown=_clean_url, scope="url", pack=3,
          key=lambda h: F.lower(_clean_url(h)), valid=lambda h: (F.length(_clean_url(h)) >= 5) & ~_clean_url(h).contains("@") & ~_doi_host(_clean_url(h))),
        D("fnr", P.FNR, lambda h: F.coalesce(_apart(_digits(h.m), C.norwegian_id), F.lit("mulig personnummer (format)")), NO, groups=0, languages=("nb", "en", "da"),
          valid=lambda h: _apart(_digits(h.m), lambda d: C.plausible(C.d_day(d), C.two(d, 2))), pack=4),
        D("orgnr_no", P.ORGNR, "organisasjonsnummer", NO, languages=("nb", "en", "da"), pack=4,
          valid=lambda h: _apart(_digits(h.m), lambda d: C.mod11(d, [3, 2, 7, 6, 5, 4, 3, 2]))),
        D("konto", P.KONTO, "kontonummer", NO, languages=("nb", "en", "da"), pack=4,
          valid=lambda h: _apart(_digits(h.m), account_ok)),
        D("phone_no", P.PHONE_NO, "telefonnummer", NO, languages=("nb", "en", "da"), reason=lambda h: phone_reason(h, h.row["technical"]), pack=4),
        D("persnr_sv", P.PERSNR_SV, lambda h: F.when(C.two(rx.last(h.g(1), 2), 0).between(61, 91), "samordningsnummer (SV)").otherwise("personnummer (SV)"), NO,
          groups=3, languages=("sv", "en"), pack=5,
          valid=lambda h: (lambda s, day: C.two(s, 2).between(1, 12) & F.when(day.between(61, 91), day - 60).otherwise(day).between(1, 31) & C.luhn(s))(
              F.concat(rx.last(h.g(1), 6), h.g(3)), C.two(rx.last(h.g(1), 2), 0))),
        D("orgnr_sv", P.ORGNR_SV, "organisasjonsnummer (SV)", NO, groups=2, languages=("sv", "en"), valid=lambda h: (C.digit(pair(h), 2) >= 2) & C.luhn(pair(h)), pack=5),
        D("phone_sv", P.PHONE_SV, "telefonnummer (SV)", NO, languages=("sv", "en"), valid=lambda h: ~bibliographic(h), pack=5),
        D("bankgiro", P.BANKGIRO, "bankgiro (SV)", NO, flags="i", groups=1, languages=("sv", "en"), shown=lambda h: h.g(1), pack=5),
        D("plusgiro", P.PLUSGIRO, "plusgiro (SV)", NO, flags="i", groups=1, languages=("sv", "en"), shown=lambda h: h.g(1), pack=5),
        D("cpr", P.CPR, "cpr-nummer", ("id",), languages=("da",), pack=6,
          valid=lambda h: C.plausible(C.two(_digits(h.m), 0), C.two(_digits(h.m), 2)) & (C.weighted(_digits(h.m), [4, 3, 2, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)),
        D("uk_ni", P.UK_NI, "UK National Insurance Number", ("id", "telefon"), flags="i", groups=6, languages=en, pack=7,
          valid=lambda h: ~F.upper(pair(h)).isin(*P.UK_NI_NEVER),
          shown=lambda h: F.upper(F.concat_ws(" ", pair(h), h.g(3), h.g(4), h.g(5), h.g(6)))),
        D("us_ssn", P.US_SSN, "US Social Security Number", ("id", "telefon"), groups=3, languages=en, raw=lambda h: h.m, pack=7,
          shown=lambda h: F.concat(F.substr(h.g(1), F.lit(1), F.lit(1)), F.lit("**-**-"), h.g(3)),
          valid=lambda h: ~h.g(1).isin("000", "666") & ~h.g(1).startswith("9") & (h.g(2) != "00") & (h.g(3) != "0000")),
        D("us_phone", P.US_PHONE, "telefonnummer", ("id", "telefon"), languages=en, valid=lambda h: ~bibliographic(h), pack=7),
        D("steuer_id", P.STEUER, "steueridentifikationsnummer (DE)", ("id", "telefon"), languages=("de",), near=(rx.java(P.STEUER_WORDS, "i"), 120), pack=8,
          valid=lambda h: reduce(lambda a, k: a & (C.digit(h.m, k) != C.digit(h.m, k + 1)), range(4), F.lit(True)) & C.iso7064(h.m)),
        D("sozial", P.SOZIAL, "sozialversicherungsnummer (DE)", ("id", "telefon"), languages=("de",), near=(rx.java(P.SOZIAL_WORDS, "i"), 120), pack=8),
        D("insee", P.INSEE, "numéro de sécurité sociale (FR)", ("id", "telefon"), groups=1, languages=("fr",), scope="insee", pack=9,
          key=lambda h: h.compact(), valid=lambda h: _insee_ok(h.compact())),
        D("dni", P.DNI, "DNI (ES)", ("id", "telefon"), groups=1, languages=("es",), shown=lambda h: h.compact(), valid=lambda h: _dni_ok(h.compact()), pack=10),
        D("nie", P.NIE, "NIE (ES)", ("id", "telefon"), groups=1, languages=("es",), shown=lambda h: F.upper(h.compact()), pack=10,
          valid=lambda h: _dni_ok(F.concat(F.translate(F.substr(F.upper(h.compact()), F.lit(1), F.lit(1)), "XYZ", "012"), F.substr(F.upper(h.compact()), F.lit(2), F.lit(8))))),
        D("iban", P.IBAN, "IBAN", ("konto",), flags="i", groups=1, scope="iban", key=iban, raw=iban, radius=45, valid=lambda h: _apart(iban(h), iban_ok), pack=11,
          shown=lambda h: F.concat(F.substr(iban(h), F.lit(1), F.lit(4)), F.lit("…"), rx.last(iban(h), 4))),
        D("card", P.CARD, lambda h: F.concat(F.lit("kredittkort ("), _card_type(card(h)), F.lit(")")), ("konto",), groups=1, scope="card", key=card, raw=card, pack=12,
          valid=lambda h: _card_type(card(h)).isNotNull() & C.luhn(card(h)),
          shown=lambda h: F.concat(F.substr(card(h), F.lit(1), F.lit(4)), F.repeat(F.lit(" ****"), F.floor((F.length(card(h)) - 8) / 4).cast("int")), F.lit(" "), rx.last(card(h), 4))),
        D("rate_slash", P.RATE_SLASH, lambda h: F.when(F.lower(h.g(3)).rlike("^(?:" + P.DAY_UNITS + ")"), "dagspris").otherwise("timepris"), ("finansielt",),
          groups=3, shown=pick(2), key=pick(2), valid=lambda h: ~bibliographic(h), pack=13, **money),
        D("rate_word", P.RATE_WORD, lambda h: F.when(F.lower(h.g(1)).rlike("dag|day"), "dagspris").otherwise("timepris"), ("finansielt",),
          groups=2, shown=pick(2), key=pick(2), pack=13, **money),
        D("total_row", P.TOTAL_ROW, "prosjektsum", ("finansielt",), pack=13, scope="money", radius=55, flags="im",
          shown=lambda h: _amount(F.element_at(F.regexp_extract_all(h.m, F.lit(rx.java(P.MONEY)), F.lit(1)), -1)),
          key=lambda h: _amount(F.element_at(F.regexp_extract_all(h.m, F.lit(rx.java(P.MONEY)), F.lit(1)), -1)),
          valid=lambda h: F.size(F.regexp_extract_all(h.m, F.lit(rx.java(P.MONEY)), F.lit(1))) >= 2),
        D("sum_word", P.SUM_WORD, "prosjektsum", ("finansielt",), groups=1, shown=pick(1), key=pick(1), hits=_sums, pack=13, **money),
        D("unit_price", P.UNIT_PRICE, "enhetspris", ("finansielt",), groups=2, shown=pick(2), key=pick(2), pack=13, **money),
        D("margin", P.MARGIN, lambda h: F.when(F.lower(h.g(1)).rlike("rabatt|avslag|discount"), "rabatt").otherwise("margin / påslag"), ("finansielt",),
          groups=2, shown=lambda h: F.concat(h.g(2), F.lit("%")), key=lambda h: h.g(2), pack=13, **money),
        D("company", P.COMPANY, "kundenavn", ("klient",), groups=2, radius=50, scope="company", shown=lambda h: F.concat_ws(" ", h.g(1), h.g(2)), pack=14,
          key=lambda h: F.lower(F.concat_ws(" ", h.g(1), h.g(2)))),
        D("ipv4", P.IPV4, "ip-adresse (IPv4)", EXTRA, radius=55, valid=lambda h: ~h.m.isin(*P.IPV4_NEVER), pack=15),
        D("ipv6", P.IPV6, "ip-adresse (IPv6)", EXTRA, radius=55, valid=lambda h: F.length(h.m) - F.length(F.replace(h.m, F.lit(":"), F.lit(""))) >= 3, pack=15),
        D("swift", P.SWIFT, "SWIFT/BIC-kode", EXTRA, radius=55, pack=15, hits=_swift,
          valid=lambda h: F.substr(h.m, F.lit(5), F.lit(2)).isin(_countries(spark)) & ((h.g(1) == "true") | F.substr(h.m, F.lit(1), F.lit(4)).isin(*P.SWIFT_BANKS))),
        D("passport", P.PASSPORT, "passnummer", EXTRA, radius=55, near=(rx.java(P.PASSPORT_WORDS, "i"), 100), pack=15),
        D("tax_id", P.TAX_ID, "tax identification number", EXTRA, flags="i", groups=1, radius=55, shown=_tax_value, scope="tax", pack=15,
          key=lambda h: F.upper(F.regexp_replace(_tax_value(h), r"(?U)\s+", "")), valid=lambda h: F.length(_digits(_tax_value(h))).between(6, 20)),
        D("vehicle", P.VEHICLE, "kjøretøyregistrering", EXTRA, radius=55, near=(rx.java(P.VEHICLE_WORDS, "i"), 80), shown=lambda h: F.replace(h.m, F.lit(" "), F.lit("")), pack=15),
        D("salary", P.SALARY, "lønn", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: h.g(1), scope="salary", key=lambda h: h.g(1), pack=15),
        D("hr_amount", P.HR_AMOUNT, "lønn", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: rx.strip(h.g(1), " \t"), pack=15),
        D("hr_field", P.HR_FIELD, "personalsak", EXTRA, flags="i", groups=1, radius=55, shown=FIELD, valid=SOME, pack=15),
        D("legal_field", P.LEGAL_FIELD, "juridisk forhold", EXTRA, flags="i", groups=1, radius=55, shown=FIELD, valid=SOME, pack=15),
        D("legal_phrase", P.LEGAL_PHRASE, "juridisk forhold", EXTRA, flags="i", groups=1, radius=55, shown=FIELD, valid=SOME, pack=15),
        D("child_school", P.CHILD, "barn/elevopplysning", EXTRA, flags="i", groups=1, radius=55, shown=FIELD, valid=SOME, pack=15),
        D("gps", P.GPS, "lokasjonsdata", EXTRA, flags="i", groups=2, radius=55, shown=lambda h: F.concat_ws(", ", h.g(1), h.g(2)), pack=15),
        D("mac", P.MAC, "mac-adresse", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: h.g(1), pack=15),
        D("imei", P.IMEI, "imei", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: h.g(1), pack=15),
        D("routing", P.ROUTING, "kontonummer", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: rx.squeeze(FIELD(h)), valid=lambda h: F.length(_digits(h.g(1))).between(6, 24), pack=15),
        D("medical", P.MEDICAL, "medisinsk opplysning", EXTRA, flags="i", groups=1, radius=55, shown=FIELD, valid=SOME, pack=15),
        D("label_line", P.LABEL_LINE, "konfidensielt dokument (overskrift)", EXTRA, flags="im", groups=1, radius=55, shown=lambda h: h.g(1), pack=15),
        D("metadata", P.METADATA, "dokumentmetadata", EXTRA, flags="im", groups=1, radius=55, shown=FIELD, valid=lambda h: SOME(h) & ~F.lower(FIELD(h)).isin("unknown", "none", "n/a"), pack=15),
        D("labeled_phone", P.LABELED_PHONE, "telefonnummer", EXTRA, flags="i", groups=1, radius=55, shown=lambda h: rx.strip(rx.strip(h.g(1), " \t\r\n"), " .;:,)"), pack=15,
          valid=lambda h: F.length(_digits(h.g(1))).between(7, 15) & ~rx.strip(rx.strip(h.g(1), " \t\r\n"), " .;:,)").rlike(r"[\s().-]$")),
        D("po_box", P.PO_BOX, "fysisk adresse", EXTRA, flags="i", radius=55, shown=lambda h: _ends(h.m, " \t\r\n,;"), pack=15),
        D("street", "", "fysisk adresse", EXTRA, radius=55, shown=lambda h: _ends(h.m, " \t\r\n,;."), hits=_streets, pack=15),
        D("birth_date", P.BIRTH_WORDS, "fødselsdato", EXTRA, flags="i", radius=55, shown=_birth, pack=15,
          more=lambda h: F.locate("|", F.concat(F.regexp_replace(F.substr(h.post, F.lit(1), F.lit(60)), "^(?s)(.*?" + P.DATE + ").*$", "$1|"))) - 1,
          valid=lambda h: (_birth(h) != "") & C.plausible(F.regexp_extract(_birth(h), P.DATE, 1).try_cast("int"), F.regexp_extract(_birth(h), P.DATE, 2).try_cast("int"))),
    )


def _swift(text: str) -> str:
    """BIC-shaped codes, each told whether a bank word starts within 200 characters."""
    words = rx.java(P.SWIFT_WORDS, "i")
    places = f"if({text} rlike {rx.quoted(words)}, transform({rx.offsets_sql(text, words)}, o -> o.start), null)"
    close = "array(cast(coalesce(exists(places, w -> abs(w - o.start) < 200), false) as string))"
    pattern = rx.java(P.SWIFT)
    return f"if({text} rlike {rx.quoted(pattern)}, transform(array({places}), places -> {rx.bare_sql(text, pattern, 0, close)})[0], {rx.NO_BARE})"


#: What a text must hold before a detector's pattern is tried: one of some literals in its lower-cased form, and a plain
#: look. Both are cheap, and most texts fail them. Digits are ASCII ones; all checks ask for those.
NEEDS: dict[str, tuple[tuple[str, ...], str]] = {
    "confidential": (P.CONFIDENTIAL, ""),
    "confidential_phrase": (("taushet", "tystnadsplikt", "sekretess", "classified", "restricted"), ""),
    "code_word": (P.CODE_WORDS, ""),
    "secret:openai api key": (("sk-",), ""),
    "secret:anthropic api key": (("sk-ant-",), ""),
    "secret:aws access key": ((), "AKIA|ASIA"),
    "secret:github token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), ""),
    "secret:azure storage key": (("accountkey=",), ""),
    "secret:jwt token": (("eyj",), ""),
    "secret:bearer token": (("bearer",), ""),
    "secret:private key": (("private key-----",), ""),
    "secret:passord i konfig": (("password", "passwd", "pwd", "passord", "lösenord"), ""),
    "secret:høy-entropisteng": ((), "[A-Za-z0-9+/_-]{32}"),
    "email": (("@",), ""),
    "url_http": (("://",), ""),
    "url_www": (("www.",), ""),
    "fnr": ((), "[0-9]{6}"),
    "orgnr_no": ((), "[0-9]{3}"),
    "konto": ((), "[0-9]{4}"),
    "phone_no": ((), "[0-9]{2}"),
    "persnr_sv": ((), "[0-9]{6}"),
    "orgnr_sv": ((), "[0-9]{6}"),
    "phone_sv": ((), "0[0-9]|[+]46"),
    "bankgiro": (("bankgiro", "bg", "b.g"), "[0-9]{3}"),
    "plusgiro": (("plusgiro", "pg", "p.g"), "[0-9]"),
    "cpr": ((), "[0-9]{6}"),
    "uk_ni": ((), "[0-9]{2}"),
    "us_ssn": ((), "[0-9]{3}-[0-9]{2}-"),
    "us_phone": ((), "[0-9]{4}"),
    "steuer_id": (("steuer", "tin"), "[0-9]{11}"),
    "sozial": (("versicherung", "svnr"), "[0-9]{3}"),
    "insee": ((), "[0-9]{2}"),
    "dni": ((), "[0-9]{8}"),
    "nie": ((), "[0-9]{7}"),
    "iban": ((), "[A-Za-z]{2}[0-9]{2}"),
    "card": ((), "[0-9]{4}"),
    "rate_slash": (("/", "per"), "[0-9]{2}"),
    "rate_word": (
        ("timepris", "timkostnad", "konsulent", "timrate", "taxa", "tariff", "timarvode", "dagspris", "dagsrate", "dagkostnad", "dagstimmar", "rate", "charge", "sats"),
        "[0-9]{2}",
    ),
    "total_row": (("total",), "[0-9]"),
    "sum_word": (
        ("budsjett", "prosjektsum", "tilbudssum", "kontrakts", "prosjektkostnad", "total", "samlet", "fakturabel", "anbudssum", "pristilbud", "offert", "projekt",
         "contract", "project", "invoice", "quote", "budget"),
        "[0-9]",
    ),
    "unit_price": (("unit", "price", "pris"), "[0-9]"),
    "margin": (("marg", "fortjeneste", "slag", "rabatt", "discount", "markup"), "%"),
    "company": ((), "AS|AB|LTD|LLC"),
    "ipv4": ((), r"[0-9]\.[0-9]"),
    "ipv6": ((), ":[0-9a-fA-F]*:"),
    "swift": ((), "[A-Z]{6}"),
    "passport": (("pass", "reisedokument", "travel"), "[A-Z]{2}[0-9]{7}"),
    "tax_id": (("tax", "tin", "ssn", "social", "national", "nino", "passport", "licen", "id", "vat"), "[0-9]"),
    "vehicle": (("reg", "bilskilt", "kj", "plate"), "[0-9]{5}"),
    "salary": (("lønn", "lonn", "salary", "pay", "kompensasjon", "godtgj"), "[0-9]"),
    "hr_amount": (("salary", "bonus", "compensation", "severance", "sluttpakke", "etterl", "pay"), "[0-9]"),
    "hr_field": (("sick", "absence", "frav", "termination", "notice", "oppsigelse", "warning", "advarsel", "review", "medarbeidersamtale"), "[:#]"),
    "legal_field": (("case", "report", "investigation", "matter", "incident", "sak", "domfelt", "siktet", "tiltalt", "gransking"), "[:#]"),
    "legal_phrase": (("charged", "convicted", "siktet", "tiltalt", "domfelt"), ""),
    "child_school": (
        ("student", "pupil", "child", "guardian", "parent", "school", "class", "iep", "special", "elev", "foresatt", "klasse", "skole", "barne", "ppt", "iop", "spesial"),
        "[:#]",
    ),
    "gps": (("gps", "coordinate", "koordinat", "location", "lokasjon"), "[0-9]"),
    "mac": (("mac",), "[:-]"),
    "imei": (("imei", "device"), "[0-9]{15}"),
    "routing": (("routing", "sort", "aba", "ach", "account"), "[0-9][0-9 -]{5}"),
    "medical": (("diagnos", "medic", "medisin", "prescription", "patient", "pasient", "journal", "mrn", "legemiddel", "resept"), ""),
    "label_line": (("confidential", "internal", "restricted", "secret", "classified", "konfidensielt", "fortrolig", "internt"), ""),
    "metadata": (("author", "creator", "producer", "company", "manager", "modified", "forfatter", "opprettet", "firma"), "[:=]"),
    "labeled_phone": (("tel", "phone", "mob", "fax"), "[0-9]"),
    "po_box": (("box", "postboks"), "[0-9]"),
    "street": ((), "[0-9]"),
    "birth_date": (("fødselsdato", "fodselsdato", "født", "fodt", "birth", "born", "dob"), "[0-9]"),
}


#: A text's digits: other characters as two blanks where two or more of them follow one another. Looks for digits read it
#: instead of the text, of which it is a small part.
DIGITS_ONLY = r"[^0-9+]{2,}"
OF_DIGITS = re.compile(r"(?:\[0-9\](?:\{[0-9]+\})?|-|\\\.|0|\||\[\+\]46)+")
RUN = re.compile(r"\[0-9\](?:\{([0-9]+)\})?")


def _look(look: str, text: str, digits: str) -> list[str]:
    """Conditions of a plain look, the cheapest first."""
    holds = lambda words: "(" + " or ".join(f"contains({text}, {rx.quoted(w)})" for w in words) + ")"
    if not look:
        return []
    if OF_DIGITS.fullmatch(look):
        return [f"{digits} rlike {rx.quoted(look)}"]
    if re.fullmatch(r"[A-Z]+(?:\|[A-Z]+)*|%", look):
        return [holds(look.split("|"))]
    if re.fullmatch(r"\[[:#=-]+\]", look):
        return [holds(look[1:-1])]
    runs = [int(n or 1) for n in RUN.findall(look.split("|")[0])] if "|" not in look else []
    return [f"{digits} rlike '[0-9]{{{n}}}'" for n in sorted(runs)[-1:]] + [f"{text} rlike {rx.quoted(look)}"]


def _may_hold(name: str, text: str, low: str, digits: str) -> str:
    words, look = NEEDS.get(name, ((), ""))
    looks = _look(look, text, digits)
    said = ["(" + " or ".join(f"contains({low}, {rx.quoted(w)})" for w in words) + ")"] if words else []
    return " and ".join([*(x for x in looks if x.startswith(digits)), *said, *(x for x in looks if not x.startswith(digits))]) or "true"


def _apart(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, inside a lambda: so large an expression is evaluated as it stands, not compiled as one method."""
    return F.transform(F.array(value), of)[0]


def wanted(detectors: tuple[Detector, ...], selected: tuple[str, ...] | None) -> list[tuple[int, Detector]]:
    """The detectors that a selection of categories needs, with their order."""
    return [(k, d) for k, d in enumerate(detectors) if selected is None or set(d.keys) & set(selected)]


def _rows(k: int, d: Detector) -> str:
    text, lang = "doc.text", "doc.language"
    found = d.hits(text) if d.hits else rx.bare_sql(text, rx.java(d.pattern, d.flags), d.groups)
    if d.near:
        found = rx.near_sql(found, text, *d.near)
    due = _may_hold(d.name, text, "doc.low", "doc.digits")
    if d.languages:
        due = f"{lang} in ({', '.join(map(rx.quoted, d.languages))}) and {due}"
    return f"transform(if({due}, {found}, {rx.NO_BARE}), (h, i) -> named_struct('k', {k}, 'match_ord', i, 'h', h))"


def _all_hits(run: list[Detector]) -> str:
    """SQL of the hits of all detectors in ``text``, read in ``language``: structs (k, match_ord, start, end, m, g, pre, post)."""
    each = ", ".join(_rows(n, d) for n, d in enumerate(run))
    fields = {"text": "text", "low": "lower(text)", "digits": f"regexp_replace(text, {rx.quoted(DIGITS_ONLY)}, '  ')", "language": "language"}
    doc = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items() if k == "text" or f"doc.{k}" in each) + ")"  # what no detector of the run reads is not made
    row = f"named_struct('k', r.k, 'match_ord', r.match_ord, 'start', r.h.start, 'end', r.h.`end`, 'm', r.h.m, 'g', r.h.g, {rx.around_sql('doc.text', 'r.h')})"
    # Inside a lambda the expression is evaluated as it stands, not compiled as one method, which would be too large.
    return f"transform(array({doc}), doc -> transform(flatten(array({each})), r -> {row}))[0]"


def _judged(run: list[Detector], r: dict[str, Column]) -> Column:
    """What rules say of a hit ``r`` of one of ``run``: ok, category, text, raw_text, reason, key, more."""
    h, k = Hit(r), r["k"]

    def chosen(of: Callable[[Detector], Expr | None], default: Column) -> Column:
        out = None
        for n, d in enumerate(run):
            if (value := of(d)) is not None:
                out = (out if out is not None else F).when(k == n, value(h))
        return default if out is None else out.otherwise(default)

    nothing = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(chosen(lambda d: d.valid, F.lit(True)), F.lit(False)).alias("ok"),
        chosen(lambda d: None if isinstance(d.category, str) else d.category, nothing).alias("category"),
        chosen(lambda d: d.shown, h.m).alias("text"),
        chosen(lambda d: d.raw, F.lit("")).alias("raw_text"),
        chosen(lambda d: d.reason, nothing).alias("reason"),
        chosen(lambda d: d.key, nothing).alias("key"),
        chosen(lambda d: d.more, F.lit(0)).alias("more"),
    )


#: Expressions of ``_judged`` by application and detectors: to build one for all detectors takes seconds.
_BUILT: dict[tuple[str, ...], Column] = {}


def _kept(spark: SparkSession, run: list[Detector]) -> Column:
    """The hits of a document (hits, technical) that rules let through, each with what they say as t.

    They are judged before they become rows: a filter over rows would judge each hit once more.
    """
    key = (spark.sparkContext.applicationId, *(d.name for d in run))
    if key not in _BUILT:
        seen = lambda r: F.struct(*(r[c].alias(c) for c in ("k", "match_ord", "start", "end", "m", "pre", "post")), _judged(run, {**{c: r[c] for c in ("k", "m", "g", "pre", "post")}, "technical": F.col("technical")}).alias("t"))
        _BUILT[key] = F.filter(F.transform("hits", seen), lambda x: x["t"]["ok"])
    return _BUILT[key]


FINDING = (
    "doc_id", "det_ord", "sub_ord", "match_ord", "detector", "engine", "category", "text", "raw_text", "context", "start", "end", "severity", "confidence",
)


def scan(docs: DataFrame, categories: list[str] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Findings and suppressed candidates of ``docs`` (doc_id, text, language, technical): ``FINDING`` and reason.

    reason is null for findings. Null texts have none. ``only`` names detectors to run; ``categories`` prunes them.
    """
    detectors = registry(docs.sparkSession)
    run = [(k, d) for k, d in wanted(detectors, dims.selected_keys(categories)) if only is None or d.name in only]
    if not run:
        return docs.limit(0).select("doc_id", *(F.lit(None).cast("int" if c.endswith("ord") or c in ("start", "end") else "string").alias(c) for c in FINDING[1:]), F.lit(None).cast("string").alias("reason"))
    place = lambda values: F.expr(f"element_at(array({', '.join(values)}), k + 1)")

    base = docs.where("text is not null").select("doc_id", F.length("text").alias("length"), "technical", F.expr(_all_hits([d for _, d in run])).alias("hits"))
    seen = base.select("doc_id", "length", F.explode(_kept(docs.sparkSession, [d for _, d in run])).alias("r")).select("doc_id", "length", "r.*")
    more = F.col("t.more")
    context = rx.snippet(
        F.col("pre"), F.concat("m", F.substr("post", F.lit(1), more)), F.substr("post", more + 1, F.lit(rx.AROUND)),
        F.col("start"), F.col("end") + more, F.col("length"), place([str(d.radius) for _, d in run]),
    )
    known = place([rx.quoted(d.category) if isinstance(d.category, str) else "cast(null as string)" for _, d in run])
    scope = place([rx.quoted(d.scope) if d.scope else "cast(null as string)" for _, d in run])
    told = seen.select(
        "doc_id", "k", "match_ord", "start", "end", F.coalesce("t.category", known).alias("category"), "t.text", "t.raw_text", "t.reason", "t.key",
        scope.alias("scope"), context.alias("context"),
    )
    if any(d.scope for _, d in run):
        first = Window.partitionBy("doc_id", "scope", "category_key", "key").orderBy("k", "match_ord")
        # Values that need not be the first of their kind are keyed by their place, so none shares a group.
        told = told.withColumn("category_key", F.when(F.col("scope") == "money", F.col("category"))).withColumn(
            "key", F.when(F.col("scope").isNull(), F.concat_ws(":", "k", "match_ord")).otherwise(F.col("key"))
        )
        told = told.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return told.select(
        "doc_id", place([str(d.pack) for _, d in run]).alias("det_ord"), place([str(k) for k, _ in run]).alias("sub_ord"), "match_ord",
        place([rx.quoted(d.name) for _, d in run]).alias("detector"), F.lit("rule").alias("engine"),
        "category", "text", F.when(F.col("raw_text") == "", F.col("text")).otherwise(F.col("raw_text")).alias("raw_text"), "context", "start", "end",
        dims.severity("category").alias("severity"), F.lit(None).cast("string").alias("confidence"), "reason",
    )
