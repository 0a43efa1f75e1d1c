"""Binary files of a log: write-ahead records, snapshots, vote files and captured message frames.

Readers take the rows of Spark's binaryFile source (path, content) and decode with generators, one file a row; a damaged
tail ends a file's records and is reported. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.functions import codes
from ledgerloom.operators.fold import Snapshot
from ledgerloom.shipping import ship

# Fixed values of the formats.
WAL_MAGIC, WAL_HEADER, WAL_MOST = 0x4C41575F, struct.Struct("<IIII"), 8 << 20
SNAPSHOT_MAGIC, SNAPSHOT_VERSION, SNAPSHOT_ORDERS = 0x50414E53, 1, 50 << 20
VOTE_MAGIC = 0x42545353
FRAME_MAGIC, FRAME_VERSION, FRAME_HEADER, FRAME_MOST, FRAME_ENTRIES, TEXT_MOST = 0x544E4553, 1, struct.Struct("<IHHI"), 1 << 20, 512, 256
MESSAGES = {1: "HELLO", 2: "HEARTBEAT", 3: "COMMAND_FORWARD", 4: "EVENT_ACK", 10: "APPEND_ENTRIES", 11: "APPEND_RESPONSE", 20: "REQUEST_VOTE", 21: "VOTE_RESPONSE"}

_NEW, _CANCEL, _ENTRY = struct.Struct("<QIBBBqQ"), struct.Struct("<Q"), struct.Struct("<QQ")
_SNAP, _ORDER = struct.Struct("<IHQQQIQQQBqQBqQI"), struct.Struct("<QBqQQ")


class Damaged(ValueError):
    """Bytes that are no valid record."""


# commands and log entries


def encode_command(c: dict) -> bytes:
    if c["kind"] == "C":
        return b"\x01" + _CANCEL.pack(c["id"])
    return b"\x00" + _NEW.pack(c["id"], c["instrument"], codes.SIDES.index(c["side"]), codes.TYPES.index(c["type"]), codes.TIFS.index(c["tif"]), c["price"], c["quantity"])


def decode_command(data: bytes, at: int) -> tuple[dict, int]:
    try:
        tag = data[at]
        if tag == 0:
            oid, instrument, side, kind, tif, price, quantity = _NEW.unpack_from(data, at + 1)
            if max(side, kind, tif) > 1:
                raise Damaged("a code is out of range")
            return {"kind": "N", "id": oid, "instrument": instrument, "side": codes.SIDES[side], "type": codes.TYPES[kind], "tif": codes.TIFS[tif], "price": price, "quantity": quantity}, at + 1 + _NEW.size
        if tag == 1:
            return {"kind": "C", "id": _CANCEL.unpack_from(data, at + 1)[0]}, at + 1 + _CANCEL.size
    except (struct.error, IndexError) as e:
        raise Damaged("too short") from e
    raise Damaged("an unknown kind of command")


def encode_entry(seq: int, term: int, command: dict) -> bytes:
    return _ENTRY.pack(seq, term) + encode_command(command)


def decode_entry(data: bytes) -> dict:
    """A whole log entry; what is left over is an error."""
    try:
        seq, term = _ENTRY.unpack_from(data)
    except struct.error as e:
        raise Damaged("too short") from e
    command, end = decode_command(data, _ENTRY.size)
    if end != len(data):
        raise Damaged("bytes are left over")
    return {"seq": seq, "term": term} | command


# write-ahead files


def wal_record(seq: int, payload: bytes) -> bytes:
    return WAL_HEADER.pack(WAL_MAGIC, seq & 0xFFFFFFFF, len(payload), zlib.crc32(payload)) + payload


def wal_records(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """The good records from the start of a file, and how many bytes they take; what follows is a torn tail."""
    out, at = [], 0
    while at + WAL_HEADER.size <= len(data):
        magic, seq, size, crc = WAL_HEADER.unpack_from(data, at)
        payload = data[at + WAL_HEADER.size : at + WAL_HEADER.size + size]
        if magic != WAL_MAGIC or size > WAL_MOST or len(payload) < size or zlib.crc32(payload) != crc:
            break
        out.append((seq, payload))
        at += WAL_HEADER.size + size
    return out, at


def wal_reset() -> bytes:
    """An empty write-ahead file."""
    return b""


def wal_through(data: bytes, seq: int) -> bytes:
    """A file's good records after a sequence, as a file."""
    return b"".join(wal_record(s, p) for s, p in wal_records(data)[0] if s > seq)


# snapshots


def encode_snapshot(s: Snapshot, last_seq: int, last_term: int, checksum: int) -> bytes:
    bid, bid_qty, ask, ask_qty = s.top
    head = _SNAP.pack(SNAPSHOT_MAGIC, SNAPSHOT_VERSION, last_seq, last_term, checksum, s.instrument, s.command_seq, s.event_seq, s.arrivals, bid is not None, bid or 0, bid_qty or 0, ask is not None, ask or 0, ask_qty or 0, len(s.orders))
    return head + b"".join(_ORDER.pack(*o) for o in s.orders)


def decode_snapshot(data: bytes) -> tuple[Snapshot, int, int, int]:
    """The snapshot, its last sequence and term and its state's checksum."""
    try:
        magic, version, seq, term, checksum, instrument, cmd, ev, arrivals, has_bid, bid, bid_qty, has_ask, ask, ask_qty, n = _SNAP.unpack_from(data)
    except struct.error as e:
        raise Damaged("too short") from e
    if magic != SNAPSHOT_MAGIC or version != SNAPSHOT_VERSION or has_bid > 1 or has_ask > 1 or n > SNAPSHOT_ORDERS or len(data) != _SNAP.size + n * _ORDER.size:
        raise Damaged("not a snapshot of this version, or cut off")
    orders = list(_ORDER.iter_unpack(data[_SNAP.size :]))
    if any(o[1] > 1 for o in orders):
        raise Damaged("a code is out of range")
    return Snapshot(instrument, cmd, ev, arrivals, (bid if has_bid else None, bid_qty if has_bid else None, ask if has_ask else None, ask_qty if has_ask else None), orders), seq, term, checksum


def snapshot_file(body: bytes) -> bytes:
    """A snapshot with the checksum that files carry at their end."""
    return body + struct.pack("<I", zlib.crc32(body))


def open_snapshot_file(data: bytes) -> tuple[Snapshot, int, int, int]:
    if len(data) < 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise Damaged("the checksum is wrong")
    return decode_snapshot(data[:-4])


# vote files


def vote_file(term: int, voted_for: int) -> bytes:
    body = struct.pack("<IQI", VOTE_MAGIC, term, voted_for)
    return body + struct.pack("<I", zlib.crc32(body))


def open_vote_file(data: bytes) -> tuple[int, int, bool]:
    """Term, vote (0: none), and whether the file was damaged, which counts as never having voted."""
    if len(data) != 20 or struct.unpack_from("<I", data)[0] != VOTE_MAGIC or zlib.crc32(data[:16]) != struct.unpack_from("<I", data, 16)[0]:
        return 0, 0, True
    return (*struct.unpack_from("<QI", data, 4), False)


# messages

_BODIES = {"HEARTBEAT": ("<IQ", "node_id counter"), "EVENT_ACK": ("<IQQ", "node_id through_event_seq state_checksum"), "REQUEST_VOTE": ("<QIQ", "term candidate_id last_log_seq"), "VOTE_RESPONSE": ("<QIB", "term voter_id granted"), "APPEND_RESPONSE": ("<QIQBQQ", "term node_id last_log_seq ok last_applied state_checksum")}
_APPEND = (struct.Struct("<QIQQQI"), "term leader_id prev_seq prev_term commit_seq".split())


def encode_message(kind: str, m: dict) -> bytes:
    """A frame: header and body."""
    if kind in _BODIES:
        form, names = _BODIES[kind]
        body = struct.pack(form, *(m[k] for k in names.split()))
    elif kind == "HELLO":
        said = m["address"].encode()
        body = struct.pack("<IHI", m["node_id"], m["version"], len(said)) + said
    elif kind == "COMMAND_FORWARD":
        body = struct.pack("<IQ", m["node_id"], m["origin_seq"]) + encode_command(m["command"])
    else:
        body = _APPEND[0].pack(*(m[k] for k in _APPEND[1]), len(m["entries"])) + b"".join(encode_entry(e["seq"], e["term"], e) for e in m["entries"])
    return FRAME_HEADER.pack(FRAME_MAGIC, FRAME_VERSION, next(k for k, v in MESSAGES.items() if v == kind), len(body)) + body


def decode_message(code: int, body: bytes) -> tuple[str, dict]:
    kind = MESSAGES.get(code)
    try:
        if kind in _BODIES:
            form, names = _BODIES[kind]
            found, end = dict(zip(names.split(), struct.unpack_from(form, body), strict=True)), struct.calcsize(form)
            if any(found.get(k, 0) > 1 for k in ("granted", "ok")):
                raise Damaged("a flag is out of range")
        elif kind == "HELLO":
            node, version, n = struct.unpack_from("<IHI", body)
            end = 10 + n
            if n > TEXT_MOST or end > len(body):
                raise Damaged("a text is too long")
            found = {"node_id": node, "version": version, "address": body[10:end].decode("utf-8", "replace")}
        elif kind == "COMMAND_FORWARD":
            node, origin = struct.unpack_from("<IQ", body)
            command, end = decode_command(body, 12)
            found = {"node_id": node, "origin_seq": origin, "command": command}
        elif kind == "APPEND_ENTRIES":
            *head, n = _APPEND[0].unpack_from(body)
            if n > FRAME_ENTRIES:
                raise Damaged("too many entries")
            found, end = dict(zip(_APPEND[1], head, strict=True)) | {"entries": []}, _APPEND[0].size
            for _ in range(n):
                seq, term = _ENTRY.unpack_from(body, end)
                command, end = decode_command(body, end + _ENTRY.size)
                found["entries"].append({"seq": seq, "term": term} | command)
        else:
            raise Damaged("an unknown kind of message")
    except struct.error as e:
        raise Damaged("too short") from e
    if end != len(body):
        raise Damaged("bytes are left over")
    return kind, found


class Frames:
    """Frames out of chunks of any size; stays failed after a bad header."""

    def __init__(self) -> None:
        self.held, self.failure = b"", ""

    def add(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        self.held += chunk
        at = 0
        while not self.failure and len(self.held) - at >= FRAME_HEADER.size:
            magic, version, code, size = FRAME_HEADER.unpack_from(self.held, at)
            if magic != FRAME_MAGIC or version != FRAME_VERSION or size > FRAME_MOST:
                self.failure = "BAD_MAGIC" if magic != FRAME_MAGIC else "BAD_VERSION" if version != FRAME_VERSION else "PAYLOAD_TOO_LARGE"
                break
            if len(self.held) - at < FRAME_HEADER.size + size:
                break
            yield code, self.held[at + FRAME_HEADER.size : at + FRAME_HEADER.size + size]
            at += FRAME_HEADER.size + size
        self.held = self.held[at:]


# Spark readers

#: Rows of the frames that readers give Spark: a frame for each file would cost more than reading it.
FRAME_ROWS = 10_000
LOG_COLUMNS = "seq long, term long, kind string, id long, instrument long, side string, type string, tif string, price long, quantity long"


def _rows(files: DataFrame, one, schema: str) -> DataFrame:
    """The rows of one(content) for each file. A frame holds the rows of many files, or a part of those of a large one."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    most = FRAME_ROWS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names, dtype=object)

        rest = names[1:]
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                for r in one(bytes(content)):
                    rows.append((path, *[r.get(k) for k in rest]))
                    if len(rows) == most:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return files.select("path", "content").mapInPandas(run, schema)


def read_wal(files: DataFrame) -> DataFrame:
    """The log entries of write-ahead files (path, content). Reading a file stops at its first bad record, or at the
    first entry that cannot be decoded or does not follow the one before."""

    def one(data: bytes) -> Iterator[dict]:
        last = None
        for _, payload in wal_records(data)[0]:
            try:
                e = decode_entry(payload)
            except Damaged:
                return
            if last is not None and e["seq"] != last + 1:
                return
            last = e["seq"]
            yield e

    return _rows(files, one, f"path string, {LOG_COLUMNS}")


def wal_report(files: DataFrame) -> DataFrame:
    """Records and torn bytes of each write-ahead file."""

    def one(data: bytes) -> Iterator[dict]:
        records, good = wal_records(data)
        yield {"records": len(records), "good_bytes": good, "torn_bytes": len(data) - good}

    return _rows(files, one, "path string, records long, good_bytes long, torn_bytes long")


def read_frames(files: DataFrame) -> DataFrame:
    """The messages of captured byte streams: msg_no, kind, bytes and number of entries; a bad one has an error."""

    def one(data: bytes) -> Iterator[dict]:
        from ledgerloom.sources.binary import FRAME_HEADER, MESSAGES, Damaged, Frames, decode_message

        frames = Frames()
        n = -1
        for n, (code, body) in enumerate(frames.add(data)):
            row = {"msg_no": n, "n_bytes": FRAME_HEADER.size + len(body), "kind": MESSAGES.get(code), "entries": 0, "error": None}
            try:
                _, m = decode_message(code, body)
                row["entries"] = len(m.get("entries", ()))
            except Damaged as e:
                row["error"] = str(e)
            yield row
        if frames.failure or frames.held:
            yield {"msg_no": n + 1, "n_bytes": len(frames.held), "kind": None, "entries": 0, "error": frames.failure or "CUT_OFF"}

    return _rows(files, one, "path string, msg_no long, n_bytes long, kind string, entries long, error string")


def read_snapshots(files: DataFrame) -> DataFrame:
    """Snapshot files (path, content): what they hold, with checksums of the restored book; a bad one has an error."""

    def one(data: bytes) -> Iterator[dict]:
        from ledgerloom.operators.fold import BookFold
        from ledgerloom.sources.binary import Damaged, open_snapshot_file

        try:
            s, seq, term, checksum = open_snapshot_file(data)
        except Damaged as e:
            yield {"error": str(e)}
            return
        fold = BookFold(s.instrument)
        good = fold.restore(s) and fold.state_checksum() == checksum
        yield {
            "last_seq": seq, "last_term": term, "instrument": s.instrument, "command_seq": s.command_seq, "event_seq": s.event_seq, "arrivals": s.arrivals, "orders": len(s.orders), "quantity": sum(o[3] for o in s.orders),
            "book_checksum": str(fold.book_checksum()), "state_checksum": str(fold.state_checksum()), "error": None if good else "the state is not the one that was stored",
        }

    return _rows(files, one, "path string, last_seq long, last_term long, instrument long, command_seq long, event_seq long, arrivals long, orders long, quantity long, book_checksum string, state_checksum string, error string")


def _mapped(files: DataFrame, one, extra: str) -> DataFrame:
    """Files (path, content) whose content is one(content, extra)."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [one(bytes(c), int(x)) for c, x in zip(part["content"], part["x"], strict=True)]})

    return files.selectExpr("path", "content", f"{extra} as x").mapInPandas(run, "path string, content binary")


def truncated_wal(files: DataFrame, through: str) -> DataFrame:
    """Write-ahead files without the records up to the sequence in the column `through`."""
    return _mapped(files, wal_through, through)


def vote_files(ballots: DataFrame) -> DataFrame:
    """Vote files of rows (path, term, voted_for); where `flipped` a bit is wrong, where `cut` the last byte is missing."""
    ship(ballots.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for term, vote, cut, flipped in zip(part["term"], part["voted_for"], part["cut"], part["flipped"], strict=True):
                data = bytearray(vote_file(int(term), int(vote)))
                data[5] ^= int(flipped)
                out.append(bytes(data[: len(data) - int(cut)]))
            yield pd.DataFrame({"path": part["path"], "content": out})

    return ballots.select("path", "term", "voted_for", "cut", "flipped").mapInPandas(run, "path string, content binary")


def read_votes(files: DataFrame) -> DataFrame:
    """Term, vote and whether the file was damaged, of vote files."""

    def one(data: bytes) -> Iterator[dict]:
        yield dict(zip(("term", "voted_for", "damaged"), open_vote_file(data), strict=True))

    return _rows(files, one, "path string, term long, voted_for long, damaged boolean")


def frame_files(messages: DataFrame, cut: int = 0) -> DataFrame:
    """Byte streams of messages (path, msg_no, code, n, seq and a command's columns), without their last `cut` bytes. The
    command is what a message of entries or a forwarded command carries, n times."""
    from pyspark.sql import functions as F

    ship(messages.sparkSession)
    names = ("code", "n", "seq", "kind", "id", "instrument", "side", "type", "tif", "price", "quantity")

    @F.pandas_udf("binary")
    def framed(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            command = {k: int(v) if k in ("id", "instrument", "price", "quantity") and v is not None else v for k, v in r.items()}
            seq, n, kind = int(r["seq"]), int(r["n"]), MESSAGES[int(r["code"])]
            numbers = dict.fromkeys("counter through_event_seq state_checksum term last_log_seq last_applied origin_seq prev_seq prev_term commit_seq".split(), seq) | dict.fromkeys("node_id candidate_id voter_id leader_id version".split(), n) | dict.fromkeys(("granted", "ok"), seq % 2)
            entries = [{"seq": seq + k, "term": n} | {k: v for k, v in command.items() if k not in ("seq", "n", "code")} for k in range(n)]
            out.append(encode_message(kind, numbers | {"address": "h" * n, "command": command, "entries": entries}))
        return pd.Series(out)

    rows = messages.select("path", "msg_no", framed(F.struct(*names)).alias("frame"))
    # one join of all frames: appending them one by one copies the stream for each
    joined = rows.groupBy("path").agg(F.expr("listagg(frame) within group (order by msg_no, frame)").alias("content"))
    return joined.selectExpr("path", f"substring(content, 1, length(content) - {cut}) as content")


def wal_bytes(log: DataFrame) -> DataFrame:
    """One write-ahead file for each book of a log (book, seq, term, command columns): path (the book), content."""
    ship(log.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").astype(object).where(rows.notna(), None)
        records = []
        for r in rows.to_dict("records"):
            c = {k: int(v) if k in ("id", "instrument", "price", "quantity") and v is not None else v for k, v in r.items()}
            records.append(wal_record(int(r["seq"]), encode_entry(int(r["seq"]), int(r["term"]), c)))
        return pd.DataFrame({"path": [str(key[0])], "content": [b"".join(records)]})

    return log.groupBy("book").applyInPandas(run, "path string, content binary")
