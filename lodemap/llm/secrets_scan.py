"""Secret scans: fixed patterns, and strings in a sensitive context that a primed zstandard compressor can't shorten."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, table

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Names after which an incompressible string is a secret.
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "session",
    "cookie", "webhook", "dsn",
)
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
#: Characters of a candidate, at least.
LEAST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What may stand between two parts of one secret, a part, and what ends a line (``mark``: and a key block).
_JOINT = re.compile(r"\.|[ \t]*(?:\r?\n|\\n|\\r\\n)(?:\s|\\n|\\r)*")
_PART = re.compile(r"[A-Za-z0-9+/_=-]+")
_LINE_END = re.compile(r"""["'`,;]*[ \t]*(?:\Z|(?:[\r\n]|\\[rn])+[ \t]*(?P<mark>-----END)?)""")
#: Characters between a sensitive name and a candidate, at most.
REACH = 40
#: Characters of surrounding text on either side that prime the compressor.
CONTEXT = 256
#: Marginal compressed bytes for each character from which on a candidate is a secret. Words and identifiers stay under
#: 0.5; random hexadecimal digits take 0.7 to 1 as literals in so short an input, base64 0.9 to 1.
NOVELTY = 0.65

#: Share of letter pairs from which on letters are like a word: about 96% of 65,631 distinct strings of 12 and more characters
#: without a digit in Python sources are, and about 0.5% of 12 random letters of both cases. A compressor with little text before it takes any word for novel.
WORDLIKE = 0.6
PAIRS = set((
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si "
    "om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa "
    "im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op sa ay ex ke ui fr oo ag rd ck ei sc au qu ue eu gu ga do da bi "
    "bo ba ub ib ob cr cl cu sp tt ff mm nn rr pp gr br dr ef if ki ok ap ip up av ov va vo fu mu nu lu ru du bu nk nf rm rn rk rv ds ls ms ks ps"
).split())

#: What code around secrets is made of: names, fillers and runs that aren't secret themselves.
DICTIONARY = (
    "const let var public static final private protected string return import export default class function config settings "
    "process.env os.environ getenv System.getProperty https://www.example.com http://localhost:8080 Content-Type application/json "
    "Authorization: Bearer Basic access_key_id secret_access_key client_id client_secret refresh_token private_key public_key "
    "session_token csrf_token database_url connection_string username password passwd passphrase credentials signature webhook_url "
    "your_api_key_here your-secret-key insert_token_here changeme change_me placeholder example sample dummy redacted undefined null none true false "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx ******************************** ................................ 00000000000000000000000000000000 "
    "customer_orders process_document version user_identifier item-000000 order index table column file path number count total value "
    "getUserByIdentifier createSession updateRecord findAll toString 2023-01-01T00:00:00Z 2024-12-31T23:59:59Z 2025_01 2026_02 v1 v2 v3 "
    "0123456789012345678901234567890123456789 1234567890abcdef 0123456789abcdef0123456789abcdef 0123456789ABCDEF "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ qwertyuiop asdfghjkl"
).encode()


def without_copies(text: str, candidate: str) -> list[str]:
    """Characters of ``text``, those empty that belong to ``LEAST`` or more in a row that ``candidate`` has too."""
    out = list(text)
    for i in range(len(text) - LEAST + 1):
        if text[i : i + LEAST] in candidate:
            out[i : i + LEAST] = [""] * LEAST
    return out


class Novelty:
    """Bytes that a candidate adds to its compressed surroundings, the compressor being primed with :data:`DICTIONARY`."""

    def __init__(self, dictionary: bytes = DICTIONARY):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> int:
        # Another copy of the candidate, or of a part of it that is as long as a candidate, doesn't make it less novel.
        around = ("".join(without_copies(before, candidate)[-CONTEXT:]) + " " + "".join(without_copies(after, candidate)[:CONTEXT])).encode()
        return len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def wordlike(word: str) -> bool:
    """Whether most neighbouring letters of ``word`` are pairs that words are made of; a capital only begins one."""
    pairs = [a + b for a, b in zip(word, word[1:]) if a.isalpha() and b.isalpha()]
    return sum(p.lower() in PAIRS and (p[1].islower() or p.isupper()) for p in pairs) >= WORDLIKE * len(pairs)


def _may_be(word: str) -> bool:
    return len(word) >= LEAST and any(c.isalpha() for c in word) and (any(c.isdigit() for c in word) or not wordlike(word))


def novel_spans(text: str, known: list[tuple[str, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Candidates up to ``REACH`` characters after a sensitive name, and what goes on from a secret, that nothing in ``known`` overlaps.

    A candidate has a letter and, if it is like a word, a digit.
    """
    found: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def take(start: int, end: int, report: bool = True) -> None:
        taken[start:end] = b"\1" * (end - start)
        if report:
            found.append(("novel", start, end))

    def secret(start: int, end: int, first: int) -> bool:
        """``first``: where the first part begins, if this one goes on from a secret. Parts of one secret aren't context of each other."""
        word = text[start:end]
        if not _may_be(word):
            return False
        # So much wider that copies over the edge of the context are known.
        wide, stop = CONTEXT + LEAST - 1, end
        while stop < end + wide and (joint := _JOINT.match(text, stop)) and (m := _PART.match(text, joint.end())) and _may_be(m[0]):
            stop = m.end()
        return novelty(text[max(0, first - wide) : first], word, text[stop : stop + wide]) >= least * len(word)

    def follow(start: int, end: int) -> int:
        """Takes the parts that go on directly after a secret, by a dot or a line break; gives the end of the last one."""
        first, last, lines, skipped = start, end, 1, []
        while (joint := _JOINT.match(text, end)) and (m := _PART.match(text, joint.end())):
            word, dot = m[0], joint[0] == "."
            lines += not dot
            if (before := taken.find(1, m.start(), m.end()) >= 0) or secret(*m.span(), first) or _is_rest(text, m, dot, lines, end - start):
                for s, e in [*skipped, *([] if before else [m.span()])]:
                    take(s, e)
                skipped, last = [], m.end()
            elif dot or len(word) == end - start:  # between two parts of one token or block it belongs to them
                skipped.append(m.span())
            else:
                break
            start, end = m.span()
        return last

    for _, s, e in known:
        take(s, e, report=False)
    for kind, s, e in known:
        if kind in ("assign", "access"):
            follow(s, e)
    done = 0
    for name in _SENSITIVE.finditer(text):
        # From the name on, or from where the last candidate ended; a candidate starts within reach and may be of any length.
        at = max(done, name.end())
        while (m := _CANDIDATE.search(text, at)) and m.start() <= name.end() + REACH:
            at = done = m.end()
            if taken.find(1, m.start(), m.end()) >= 0:
                at = done = follow(*m.span())
            elif secret(*m.span(), m.start()):
                take(*m.span())
                at = done = follow(*m.span())
    return found


def _is_rest(text: str, m: re.Match, dot: bool, lines: int, width: int) -> bool:
    """Whether a part too short to be judged ends a secret: the last line of a block, or the last short part of a token."""
    word = m[0]
    if len(word) >= LEAST and dot:
        return False
    if dot:
        return all(any(f(c) for c in word) for f in (str.isdigit, str.islower, str.isupper))
    if len(word) > width or not (ends := _LINE_END.match(text, m.end())):
        return False
    return bool(ends["mark"]) or lines > 2 and (any(c in "0123456789+/=" for c in word) or not wordlike(word))


def scan(text: str | None, novelty: Novelty) -> list[tuple[str, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()),
    ("base", pa.string()), ("spans", pa.string()),
])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_novel, base and spans (``kind:start:end`` by start,
    then kind, comma-joined; offsets in code points, end exclusive).

    Null and empty texts have no spans; null ids stay; repeated rows are scanned one by one; other columns are ignored; no
    rows give no rows.
    """
    made: list[Novelty] = []

    def find(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Novelty())
        out: dict[str, list] = {f: [] for f in _SCHEMA.names[1:]}
        for text in rows.column(1).to_pylist():
            spans = scan(text, made[0])
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in spans))
            out["base"].append(_joined([s for s in spans if s[0] != "novel"]))
            out["spans"].append(_joined(spans))
        return batch(_SCHEMA, doc_id=rows.column(0), **out)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(picked, find, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")


def redact(text: str | None, novelty: Novelty, mark: str = "[secret]") -> str | None:
    """``text`` with each stretch of secrets replaced by ``mark``."""
    spans = scan(text, novelty)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets taken out of ``text_col`` and ``length_col`` set to the new length of changed texts; all rows stay."""
    made: list[Novelty] = []
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Novelty())
        for rows in batches:
            old = rows.column(text_at).to_pylist()
            new = [redact(t, made[0]) for t in old]
            columns = list(rows.columns)
            columns[text_at] = pa.array(new, columns[text_at].type)
            if length_at is not None:
                lengths = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if t == u else len(u) for n, t, u in zip(lengths, old, new, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel",
    )


QUERIES = {"op6_secrets": (op6_secrets, None)}
