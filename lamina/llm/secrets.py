"""Secret scans: three patterns, and novelty of strings in sensitive places.

The patterns (kinds assign, access, hex) are exact. Novelty looks at strings without blanks that stand
shortly after a sensitive word: a zstandard compressor is primed with a dictionary of identifiers (a few
general ones, and those that most documents of the corpus hold) and the text around the string, and the
string's marginal compressed bytes, those of context and string less those of the context alone, are
measured. A string that costs nearly its entropy is new to language, code and neighbourhood alike: it is
reported as kind `novel`, unless a pattern has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices

# fixed values: the kinds in the order of ties, and their patterns
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# fixed values: words that make their neighbourhood sensitive, and parts that any of them holds
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|\bpwd\b|secret|token|credential|bearer|signature|authori[sz]ation|\bauth\b|(?:api|private|access|secret|signing|encryption)[\s_-]?key|\bkey\b", re.IGNORECASE | re.ASCII)
_HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "signature", "auth", "key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
_HEX_ONLY = re.compile(r"[0-9A-F-]+|[0-9a-f-]+")
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey credential private_key bearer authorization signature username "
    "client_id client_secret access_token refresh_token session_id user_agent content_type application_json http https www com org net "
    "example test sample placeholder changeme default configuration environment variable function return class import from self "
    "string integer boolean number value index length array object null none true false public static void const let var "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxxxxxxxxxx ------------------------ ________________________ ======================== ........................"
)
# names in code: letters only, so that no secret with digits comes in; joined by signs, or with humps
_IDENTIFIER = r"\b[A-Za-z]++(?:[_.-][A-Za-z]++)++|\b[a-z]++(?:[A-Z][a-z]++)++\b"
CORPUS_IDENTIFIERS = 2048
REACH = 128  # code points after a sensitive word in which candidates begin
AROUND = 256  # code points of context on each side


def identifiers(docs: DataFrame, most: int = CORPUS_IDENTIFIERS, text: str = "text") -> bytes:
    """The dictionary: the `most` identifiers of up to 40 characters that most documents of docs hold (two at least; of ties the first in order), and the general ones."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_IDENTIFIER), F.lit(0)))).alias("name"))
    top = found.where("length(name) between 4 and 40").groupBy("name").count().where("count > 1").orderBy(F.desc("count"), "name").limit(most).collect()
    return (" ".join(r["name"] for r in reversed(top)) + " " + IDENTIFIERS).encode()  # what is likeliest stands last, nearest to the text


class Novelty:
    def __init__(self, dictionary: bytes = IDENTIFIERS.encode(), bytes_a_character: float = 0.88, level: int = 19) -> None:
        words = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False)
        self.least = bytes_a_character

    def marginal(self, around: str, candidate: str) -> int:
        context = around.encode()
        return len(self.compressor.compress(context + b" " + candidate.encode())) - len(self.compressor.compress(context + b" "))

    def is_new(self, text: str, start: int, end: int) -> bool:
        """Whether a candidate costs nearly what random characters of its alphabet would: `least` bytes each, of hexadecimal digits two thirds of that."""
        found = text[start:end]
        humps = len(re.findall(r"[a-z](?=[A-Z])", found))
        if not (re.search(r"[A-Za-z]", found) and (re.search(r"[0-9]", found) or humps > (end - start) / 8)):
            return False
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        least = self.least * (2 / 3 if _HEX_ONLY.fullmatch(found) else 1)
        return self.marginal(around, found) >= least * (end - start)


_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    spans = []
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):  # what any match of assign holds
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if b"x" * 24 in text.encode().translate(_HEX_MAP):  # some run of hex digits is long enough
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def novel_spans(text: str, novelty: Novelty, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible candidates that begin within REACH of a sensitive word and touch no known span."""
    low = text.lower()
    if not any(word in low for word in _HINTS):
        return []
    out, done = [], 0
    for word in _SENSITIVE.finditer(text):
        at = max(word.end(), done)
        while (m := _CANDIDATE.search(text, at, word.end() + REACH + 4096)) and m.start() <= word.end() + REACH:
            m = _CANDIDATE.match(text, m.start())
            if not any(a < m.end() and m.start() < b for a, b, _ in known) and novelty.is_new(text, m.start(), m.end()):
                out.append((m.start(), m.end(), "novel"))
            at = done = m.end()
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered(spans))


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id and spans, an array of (kind, start, end) by start, then kind. Code points, end exclusive.

    A null text counts as empty. Texts are searched whole. Repeated rows and null ids have a row each. Extra columns
    are not read; an empty table gives no row. Ties in start and kind are ordered by end.
    """
    dictionary = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    rows.append([{"kind": k, "start": a, "end": b} for a, b, k in ordered(base + novel_spans(text or "", novelty, base))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by a mark (overlapping spans by one); null texts stay null.

    All rows and extra columns stay as they are, whatever their names; an empty table stays empty.
    """
    at = docs.columns.index(text)
    dictionary = identifiers(docs, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for whole in batches:
            for batch in slices(whole, text):
                out = []
                for t in batch.column(at).to_pylist():
                    base = base_spans(t or "")
                    parts, done, spans = [], 0, sorted(base + novel_spans(t or "", novelty, base))
                    for a, b, _ in spans:
                        if a >= done:
                            parts += [t[done:a], mark]
                        done = max(done, b)
                    out.append("".join([*parts, t[done:]]) if spans else t)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
