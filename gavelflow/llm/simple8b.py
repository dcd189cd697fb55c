"""Token ids in binary files, Simple-8b coded, as a Spark data source.

A 64-bit word holds a 4-bit selector and 60 bits of ids: 60 ids of one bit down to 3 of 20. An id
wider than 20 bits is an escape: zero in its place, and (place, id) in a list of the block. Blocks
hold 256 ids. A file is a run of segments; a segment holds whole documents and, for all its blocks,
where their words and escapes begin, so that a reader decodes all blocks of a segment at once, or
any one alone.

    file     magic, segments, JSON (segment offsets and totals), length of the JSON, magic
    segment  5 counts (documents, ids, blocks, words, escapes), then the arrays document id, id
             missing, length, first word of each block, first escape of each block, words, escape
             places, escape ids

Writing: each task writes one file under an attempt's name; the commit on the driver renames the
files of the successful attempts and writes the manifest with the ids in front of each file. A lost
executor only leaves an attempt that nobody names. Paths go through pyarrow's file systems.

The writer takes ``doc_id`` and ``ids`` (little-endian unsigned 32-bit bytes) in the order of the
partitions; with the options ``tokenizer`` and ``end_id`` it takes ``doc_id`` and ``text`` and encodes in
the same pass. The reader gives ``doc_id, start, n_tokens, ids``. While it is planned, this module
needs no other of the package, since Spark plans Python sources in a process of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"SIMPLE8B"
BLOCK = 256
SEGMENT_IDS = 1 << 19
#: Ids per word and bits per id, by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
WIDEST = 20
MANIFEST = "manifest.json"


def encode_blocks(ids):
    """``(words, first word of each block, escape places, escape ids, first escape of each block)``
    of unsigned 64-bit ids. All blocks advance word by word at the same time."""
    import numpy as np

    n = -(-len(ids) // BLOCK)
    grid = np.zeros((n, BLOCK + SELECTORS[0][0]), dtype=np.uint64)  # room to read behind a block
    body = np.zeros(n * BLOCK, dtype=np.uint64)
    body[:len(ids)] = ids
    wide = np.nonzero(body >> np.uint64(WIDEST))[0]
    escapes = body[wide].copy()
    body[wide] = 0
    grid[:, :BLOCK] = body.reshape(n, BLOCK)

    best = np.full((n, BLOCK), len(SELECTORS) - 1, dtype=np.int8)
    live, small = np.arange(n), grid.astype(np.uint32)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        over = np.zeros((len(live), grid.shape[1] + 1), dtype=np.uint16)
        np.cumsum(small >= (1 << bits), axis=1, out=over[:, 1:])
        fits = over[:, count:count + BLOCK] == over[:, :BLOCK]
        some = fits.any(axis=1)  # narrower selectors hold more ids: they fit nowhere where this one does not
        live, small, fits = live[some], small[some], fits[some]
        if not len(live):
            break
        best[live] = np.where(fits, np.int8(s), best[live])

    counts = np.array([c for c, _ in SELECTORS])
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    taken = []
    while len(rows):
        chosen = best[rows, at[rows]]
        taken.append((rows, at[rows], chosen))
        at[rows] += counts[chosen]
        rows = rows[at[rows] < BLOCK]
    if not taken:
        empty = np.zeros(0, dtype=np.uint64)
        return empty, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint16), empty, np.zeros(1, dtype=np.int64)
    row, place, selector = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(row, kind="stable")
    row, place, selector = row[order], place[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        of = np.nonzero(selector == s)[0]
        for k in range(count if len(of) else 0):
            words[of] |= grid[row[of], place[of] + k] << np.uint64(k * bits)
    first = np.searchsorted(row, np.arange(n + 1))
    return words, first, (wide % BLOCK).astype(np.uint16), escapes, np.searchsorted(wide // BLOCK, np.arange(n + 1))


def decode_blocks(words, first, places, escapes, first_escape, n_ids: int):
    """The ids of all blocks."""
    import numpy as np

    n = len(first) - 1
    out = np.zeros(n * BLOCK, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(n), np.diff(first))
    inside = before - before[first[:-1]][block] if len(words) else before
    for s, (count, bits) in enumerate(SELECTORS):
        of = np.nonzero(selector == s)[0]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(of) else 0):
            ok = of[inside[of] + k < BLOCK]
            out[block[ok] * BLOCK + inside[ok] + k] = (words[ok] >> np.uint64(k * bits)) & mask
    out[np.repeat(np.arange(n), np.diff(first_escape)) * BLOCK + places] = escapes
    return out[:n_ids]


def segment_bytes(doc_ids: list, ids: list[bytes]) -> bytes:
    import numpy as np

    lengths = np.array([len(x) // 4 for x in ids], dtype="<i8")
    flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.uint64)
    words, first, places, escapes, first_escape = encode_blocks(flat)
    head = np.array([len(ids), len(flat), len(first) - 1, len(words), len(escapes)], dtype="<i8")
    return b"".join(x.tobytes() for x in (
        head, np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype=np.uint8), lengths,
        first.astype("<i8"), first_escape.astype("<i8"), words.astype("<u8"), places.astype("<u2"), escapes.astype("<u8")))


def segment_documents(data: bytes):
    """``(document ids, lengths, ids)`` of one segment; the ids as one array."""
    import numpy as np

    at = 0

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    docs, n_ids, blocks, n_words, n_escapes = take("<i8", 5).tolist()
    doc_ids, missing, lengths = take("<i8", docs), take(np.uint8, docs), take("<i8", docs)
    first, first_escape = take("<i8", blocks + 1), take("<i8", blocks + 1)
    words, places, escapes = take("<u8", n_words), take("<u2", n_escapes), take("<u8", n_escapes)
    named = [None if m else d for d, m in zip(doc_ids.tolist(), missing.tolist(), strict=True)]
    return named, lengths, decode_blocks(words, first, places.astype(np.int64), escapes, first_escape, n_ids)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Written(WriterCommitMessage):
    def __init__(self, partition: int, name: str, docs: int, ids: int) -> None:
        self.partition, self.name, self.docs, self.ids = partition, name, docs, ids


class Simple8bWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
        self.path, self.tokenizer, self.end = path, tokenizer, end_id.to_bytes(4, "little")

    def _documents(self, iterator):
        """``(doc_id, ids)`` one by one."""
        for batch in iterator:
            columns = batch.to_pydict()
            names = columns["doc_id"]
            if self.tokenizer is None:
                yield from zip(names, columns["ids"], strict=True)
                continue
            from gavelflow.llm.ids import batches, encoder

            texts, encode = columns["text"], encoder(self.tokenizer).encode
            for a, b in batches(texts):
                for name, ids in zip(names[a:b], encode(texts[a:b]), strict=True):
                    yield name, ids + self.end

    def write(self, iterator):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"_attempt-{partition:06d}-{uuid.uuid4().hex}"
        segments, total_docs, total_ids = [], 0, 0
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            at = len(MAGIC)
            doc_ids, ids, size = [], [], 0

            def flush():
                nonlocal at, doc_ids, ids, size, total_docs, total_ids
                if doc_ids:
                    data = segment_bytes(doc_ids, ids)
                    out.write(data)
                    segments.append([at, len(data)])
                    at, total_docs, total_ids = at + len(data), total_docs + len(doc_ids), total_ids + size
                    doc_ids, ids, size = [], [], 0

            for d, x in self._documents(iterator):
                doc_ids.append(d)
                ids.append(x)
                size += len(x) // 4
                if size >= SEGMENT_IDS:
                    flush()
            flush()
            foot = json.dumps({"segments": segments, "documents": total_docs, "ids": total_ids}).encode()
            out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        return Written(partition, name, total_docs, total_ids)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            name = f"shard-{m.partition:06d}.s8b"
            system.move(f"{root}/{m.name}", f"{root}/{name}")
            files.append({"name": name, "documents": m.docs, "ids": m.ids, "start": start})
            start += m.ids
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"block": BLOCK, "files": files, "ids": start}).encode())

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


class Shard(InputPartition):
    def __init__(self, name: str, start: int) -> None:
        self.name, self.start = name, start


class Simple8bReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        system, root = file_system(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [Shard(x["name"], x["start"]) for x in json.loads(f.read())["files"]] or [Shard("", 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        if not partition.name:
            return
        system, root = file_system(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as f:
            end = f.size()
            tail = f.read_at(16, end - 16)
            if tail[8:] != MAGIC:
                raise ValueError(f"{partition.name} is cut off")
            size = int.from_bytes(tail[:8], "little")
            start = partition.start
            for at, length in json.loads(f.read_at(size, end - 16 - size))["segments"]:
                doc_ids, lengths, ids = segment_documents(f.read_at(length, at))
                ends = np.cumsum(lengths)
                data, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                values = [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                start += int(ends[-1])


class Simple8b(DataSource):
    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return Simple8bReader(self.options["path"])

    def writer(self, schema, overwrite):
        return Simple8bWriter(self.options["path"], self.options.get("tokenizer"), int(self.options.get("end_id", 1)))
