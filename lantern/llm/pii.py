"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts the score.

Kinds, in the order of the output: email, ip, card (Luhn) and phone, which the contract fixes, and
those that the method adds: iban (mod 97), nif (a Spanish identity number, letter by mod 23), nir (a
French insurance number, mod 97), steuer (a German tax number, mod 11 and 10) and secret (tokens
and keys, by CRC-32, JSON header or entropy). A span of a base kind is always reported; an added one
only if its checksum holds and its score reaches the threshold. Scores start from the kind, rise with
a checksum that holds and with words nearby that name such data, and sink with words that name
something else. Kinds whose checksum is weak start so low that they need such a word; a token that
proves what it is, by its CRC-32, its JSON header or a form that only such keys have, needs none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

#: The order of kinds in the output (fixed by the contract, with the added kinds after).
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "nif", "nir", "steuer", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

# The contract's patterns, written so that no long run of characters is scanned twice: a run of
# digits is taken whole (a match never begins inside one), and an address is sought from its '@'.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# The patterns of the added kinds. Those with numbers are bounded, so a failed match costs little.
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
_NIF = re.compile(r"(?<![\w-])(?:[XYZ][ -]?[0-9]{7}|[0-9]{8})[ -]?[A-HJ-NP-TV-Z](?![\w-])")
_NIR = re.compile(r"(?<![\w.-])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[2-9][0-9]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![\w-])")
_STEUER = re.compile(r"(?<![\w.-])[1-9][0-9](?: ?[0-9]{3}){3}(?![\w-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{20,}+")

#: Words that name a kind of data, and words that name other numbers; fixed values.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "nif": ("nif", "dni", "nie", "documento", "identidad", "identity", "fiscal"),
    "nir": ("nir", "sécurité", "sociale", "insee", "assuré", "security", "social"),
    "steuer": ("steuer", "steuernummer", "steuer-id", "steueridentifikationsnummer", "idnr", "tax", "tin"),
    "secret": ("token", "secret", "key", "apikey", "api-key", "api_key", "password", "passwd", "pwd", "auth", "bearer", "authorization", "credential"),
}
ELSEWHERE = ("version", "isbn", "issn", "order", "invoice", "serial", "tracking", "sku", "checksum", "commit", "sha1", "sha256", "md5")
START = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "nif": 0.1, "nir": 0.2, "steuer": 0.05, "secret": 0.1}
_WORDS = re.compile(r"[^\W\d_](?:[\w-]*\w)?")
_NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed by the number's definition
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Policy:
    window: int = 40  # characters of context on either side
    checksum: float = 0.4
    proof: float = 0.3  # besides, for secrets that prove what they are
    context: float = 0.2
    threshold: float = 0.6  # of added kinds
    entropy: float = 3.0  # bits a character, least for a secret without a checksum of its own


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97, letters counting from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def nif_holds(number: str) -> bool:
    """Whether the letter of a Spanish number (8 digits, or X, Y, Z and 7) is that of the rest by 23."""
    return number[-1] == _NIF_LETTERS[int(number[:-1].translate(str.maketrans("XYZ", "012"))) % 23]


def nir_holds(number: str) -> bool:
    """Whether the last two digits of a French number are 97 less the rest by 97; Corsica's 2A and 2B are 19 and 18."""
    body = number[:-2].replace("2A", "19").replace("2B", "18")
    return 97 - int(body) % 97 == int(number[-2:])


def steuer_holds(number: str) -> bool:
    """ISO 7064 mod 11, 10; besides, among the first ten digits one comes twice or three times and the others once at most."""
    seen = sorted(Counter(number[:10]).values())
    if seen[-1] not in (2, 3) or seen[-2] > 1:
        return False
    product = 10
    for digit in number[:10]:
        total = (int(digit) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(number[10])


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def secret_proves(token: str) -> bool | None:
    """Whether a token of a known form is one, by its CRC-32, its JSON header or that form alone; None: the form is none of these."""
    if re.fullmatch(r"gh[pousr]_[A-Za-z0-9]{36}", token):
        rest, digits = zlib.crc32(token[4:34].encode()), ""
        while rest:
            rest, digit = divmod(rest, 62)
            digits = _BASE62[digit] + digits
        return digits.rjust(6, "0") == token[-6:]
    if token.startswith("eyJ") and token.count(".") == 2:
        head = token.split(".")[0]
        try:
            header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error, RecursionError):
            return False
        return isinstance(header, dict) and "alg" in header
    return True if re.fullmatch(r"(?:AKIA|ASIA)[A-Z2-7]{16}", token) else None


def secret_holds(token: str, least: float) -> bool:
    """Whether a token is random enough to be a secret, where its form tells nothing."""
    mixed = any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)
    return mixed and "." not in token and _entropy(token) >= least


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the last match ended
    for found in _DOMAIN.finditer(text):
        start = at = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = found.end()
            yield start, free


def _is_ip(text: str) -> bool:
    parts = [part.lstrip("0") or "0" for part in text.split(".")]
    return all(len(part) <= 3 and int(part) <= 255 for part in parts)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind in order, then by start."""
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", *s) for s in _emails(text)]
    if "." in text:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() > 12 and _is_card(m[0])]
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def iban_spans(text: str) -> Iterator[tuple[int, int]]:
    """Accounts whose checksum holds, the longest at each place; what follows in capitals or digits may be another one.

    A proposal that no end makes valid is left at its next group, so that an account that it has
    swallowed is still found.
    """
    at = 0
    while found := _IBAN.search(text, at):
        start, end = found.span()
        while end > start:
            account = text[start:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                break
            end = text.rfind(" ", start, end) if " " in text[start:end] else start
        if end > start:
            yield start, end
            at = end
        else:
            at = text.find(" ", start, found.end()) + 1 or found.end()


def added_spans(text: str, policy: Policy) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, proved) of the added kinds whose checksum holds, by kind in order, then by start."""
    yield from (("iban", *s, False) for s in iban_spans(text))
    checks: dict[str, tuple[re.Pattern, Callable[[str], bool]]] = {"nif": (_NIF, nif_holds), "nir": (_NIR, nir_holds), "steuer": (_STEUER, steuer_holds)}
    for kind, (pattern, holds) in checks.items():
        for m in pattern.finditer(text):
            if holds(m[0].replace(" ", "").replace("-", "")):
                yield kind, *m.span(), False
    for m in _SECRET.finditer(text):
        token = m[0].strip("=.-+/") if m[0][-1] in ".-" else m[0]
        start = m.start() + m[0].find(token)
        if "=" in token.rstrip("="):  # name=value
            name = token.rstrip("=").rindex("=") + 1
            start, token = start + name, token[name:]
        if len(token) < 20:
            continue
        proved = secret_proves(token)
        if proved or proved is None and secret_holds(token, policy.entropy):
            yield "secret", start, start + len(token), bool(proved)


def _score(text: str, kind: str, start: int, end: int, checked: bool, policy: Policy) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - policy.window) : start] + " " + text[end : end + policy.window])}
    score = START[kind] + policy.checksum * checked
    score += policy.context * any(w in near for w in CONTEXT[kind])
    score -= policy.context * any(w in near for w in ELSEWHERE)
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None, policy: Policy = Policy()) -> list[dict]:
    """All spans of a text with their scores; offsets are code points, the end excluded."""
    text = text or ""
    found = [{"kind": k, "start": a, "end": b, "score": _score(text, k, a, b, k == "card", policy)} for k, a, b in base_spans(text)]
    for k, a, b, proved in added_spans(text, policy):
        score = round(min(1.0, _score(text, k, a, b, True, policy) + policy.proof * proved), 3)
        if score >= policy.threshold:
            found.append({"kind": k, "start": a, "end": b, "score": score})
    return found


def with_spans(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(doc_id, spans) of every row of `docs` (doc_id, text; others are ignored).

    `spans` is an array of (kind, start, end, score), by kind in order, then by start. A null or
    empty text has none. An empty table gives an empty result.
    """

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            yield {"doc_id": row["doc_id"], "spans": find_spans(row["text"], policy)}

    return arrow.map_rows(docs.select("doc_id", "text"), run, arrow.schema(docs.schema["doc_id"], "spans array<struct<kind:string,start:int,end:int,score:double>>"))


def redacted(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in brackets.

    All columns are kept, whatever their names. Null and empty texts stay as they are, as do texts
    without spans. An empty table gives an empty result.
    """

    def cut(text: str | None) -> dict:
        parts, at = [], 0
        for span in sorted(find_spans(text, policy), key=lambda s: (s["start"], -s["end"])):
            if span["start"] >= at:
                parts += [text[at : span["start"]], f"[{span['kind']}]"]
                at = span["end"]
        return {"text": "".join(parts) + text[at:] if parts else text}

    rows = arrow.extend(shared.packed(docs).select("_row", "_row.text"), ["_row"], "text", cut, "text string")
    return rows.select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def find_personal_data(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Counts and digests of the spans of every row of `docs` (doc_id, text; others are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans written as
    kind:start:end and joined by commas), spans (all spans, joined likewise), scores (theirs, in
    the same order), n_spans and a count for each added kind. A null or empty text has no spans:
    zero counts, the digest of '', and ''. Repeated rows are each reported. An empty table gives an
    empty result.
    """

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            spans = find_spans(row["text"], policy)
            written = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
            base = [w for w, s in zip(written, spans) if s["kind"] in BASE_KINDS]
            yield {
                "doc_id": row["doc_id"],
                "base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest(),
                "spans": ",".join(written),
                "scores": ",".join(f"{s['score']:.2f}" for s in spans),
                "n_spans": len(spans),
            } | {f"n_{k}": sum(s["kind"] == k for s in spans) for k in KINDS}

    counts = [", ".join(f"n_{k} long" for k in kinds) for kinds in (BASE_KINDS, ADDED_KINDS)]
    ddl = f"{counts[0]}, base_sha256 string, spans string, scores string, n_spans long, {counts[1]}"
    return arrow.map_rows(docs.select("doc_id", "text"), run, arrow.schema(docs.schema["doc_id"], ddl))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(shared.table(spark, sf_dir, "documents"))
