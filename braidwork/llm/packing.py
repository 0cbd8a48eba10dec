"""Vector bin packing of documents into training sequences.

Items are (tokens, segments, loss-bearing tokens); a sequence limits all three.
The dot-product heuristic fills one sequence at a time: of the items that fit,
it takes the one whose size has the largest dot product with the room left, both
in units of the limits. Items of equal size form a class, so a choice is one
vector operation over the classes. Where nothing fits any more, the largest item
is cut to fill the sequence; a document of several sequences is cut into whole
ones first. What remains at the end of a block is cut at powers of two, which
need no padding.

Packing is local to a block of about BLOCK_TOKENS tokens of one input partition:
there is no shuffle, memory is bounded and the waste is below one short sequence
a block.

The first token of a piece has no context, so a piece of n tokens bears loss on
n - 1, unless a column says how many of a document's last tokens bear loss (as
the answer of an instruction does).

Edge cases: null and empty texts are one end token; repeated rows are packed
each; of items of equal gain the shorter goes first; a text of any length is cut
into sequences; columns of clashing names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import prepare, table, trim
from braidwork.llm.token_ids import ENCODE_BYTES, vocabulary_path, word_tokenizer

SEQUENCE, SEGMENTS, LOSS = 4096, 256, 4096
#: Room of fewer tokens than this is left rather than filled with a cut piece.
LEAST_CUT = 8
BLOCK_TOKENS = 2_000_000


def loss_of(start: int, length: int, total: int, bearing: int) -> int:
    """Loss-bearing tokens of a piece: of the document's last `bearing`, without the piece's first."""
    first = max(start + 1, total - bearing)
    return max(0, start + length - first)


def pack(totals: list[int], bearing: list[int], tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = LOSS, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every token lies in one piece."""
    if loss < 1 or segments < 1 or tokens < 1:
        raise ValueError("limits must be positive")
    out: list[list[tuple[int, int, int]]] = []
    waiting: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)

    def fits_alone(doc: int, start: int, length: int) -> int:
        """The longest cut from start that keeps the limits by itself."""
        while length > 1 and loss_of(start, length, totals[doc], bearing[doc]) > loss:
            length -= loss_of(start, length, totals[doc], bearing[doc]) - loss
        return length

    def wait(doc: int, start: int) -> None:
        while start < totals[doc]:
            length = fits_alone(doc, start, min(tokens, totals[doc] - start))
            if length == tokens:
                out.append([(doc, start, length)])
            else:
                waiting[(length, loss_of(start, length, totals[doc], bearing[doc]))].append((doc, start, length))
            start += length

    for doc in range(len(totals)):
        wait(doc, 0)
    sizes = np.array(sorted(waiting), np.int64).reshape(-1, 2)
    left = np.array([len(waiting[tuple(s)]) for s in sizes.tolist()], np.int64)
    limit = np.array([tokens, loss], np.float64)
    open_: list[tuple[int, int, int]] = []
    room = [tokens, segments, loss]

    def add(piece: tuple[int, int, int]) -> None:
        doc, start, length = piece
        open_.append(piece)
        room[0] -= length
        room[1] -= 1
        room[2] -= loss_of(start, length, totals[doc], bearing[doc])

    def close() -> None:
        nonlocal open_
        out.append(open_)
        open_ = []
        room[:] = [tokens, segments, loss]

    def put_back(doc: int, start: int, length: int) -> None:
        nonlocal sizes, left
        size = (length, loss_of(start, length, totals[doc], bearing[doc]))
        waiting[size].append((doc, start, length))
        at = np.flatnonzero((sizes[:, 0] == size[0]) & (sizes[:, 1] == size[1]))
        if len(at):
            left[at[0]] += 1
        else:
            sizes, left = np.vstack([sizes, size]), np.append(left, 1)

    while left.any():
        fit = np.flatnonzero((left > 0) & (sizes[:, 0] <= room[0]) & (sizes[:, 1] <= room[2])) if room[1] else []
        if len(fit):
            gain = (sizes[fit] / limit) @ (np.array([room[0], room[2]]) / limit)  # a segment's term is the same for all
            k = fit[np.argmax(gain)]
            add(waiting[tuple(sizes[k].tolist())].pop())
            left[k] -= 1
            if not left[k] and np.count_nonzero(left) * 2 < len(left):
                sizes, left = sizes[left > 0], left[left > 0]
        elif open_ and room[1] and room[0] >= least_cut and room[2] >= 1:
            k = np.flatnonzero(left)[np.argmax(sizes[left > 0][:, 0])]
            doc, start, length = waiting[tuple(sizes[k].tolist())].pop()
            left[k] -= 1
            cut = min(room[0], length - 1)
            while cut > 0 and loss_of(start, cut, totals[doc], bearing[doc]) > room[2]:
                cut -= loss_of(start, cut, totals[doc], bearing[doc]) - room[2]
            if cut > 0:
                add((doc, start, cut))
                put_back(doc, start + cut, length - cut)
                if room[0]:
                    close()
            else:
                put_back(doc, start, length)
                close()
        else:
            close()
        if not room[0]:
            close()
    last, out_ = open_, out
    size, own = sum(p[2] for p in last), []
    if last and size < tokens:  # cut at powers of two
        for bit in reversed(range(size.bit_length())):
            want = (1 << bit) if size >> bit & 1 else 0
            own = []
            while want:
                doc, start, length = last.pop(0)
                take = min(want, length)
                own.append((doc, start, take))
                want -= take
                if take < length:
                    last.insert(0, (doc, start + take, length - take))
            if own:
                out_.append(own)
    elif last:
        out_.append(last)
    return out_


def pack_documents(docs: DataFrame, end_id: int = 2, bearing: str | None = None, answer: str | None = None, vocabulary: str | None = None, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = LOSS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, segment, loss_tokens, sequence_tokens, padded_to.

    bearing: a column with the number of a document's last tokens that bear
    loss (null: all). answer: a text column that follows the text and alone bears
    loss, with the end token. padded_to: the sequence's length with padding.
    """
    prepare(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col(bearing).cast("long") if bearing else F.lit(None).cast("long")).alias("bearing"), (F.coalesce(F.col(answer), F.lit("")) if answer else F.lit(None).cast("string")).alias("answer"))

    def sequences(batches):
        from pyspark import TaskContext

        from braidwork.llm.common import gathered_batches

        tokenizer, part, done = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, bodies, bears, total = [], [], [], 0

        def flush():
            nonlocal done
            totals = [len(b) // 4 for b in bodies]
            found = pack(totals, [t if b is None else min(b, t) for t, b in zip(totals, bears, strict=True)], tokens, segments, loss)
            out = defaultdict(list)
            for number, pieces in enumerate(found):
                offset, size = 0, sum(p[2] for p in pieces)
                for segment, (doc, start, length) in enumerate(pieces):
                    b = totals[doc] if bears[doc] is None else min(bears[doc], totals[doc])
                    for name, value in (("doc", doc), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(memoryview(bodies[doc])[4 * start : 4 * (start + length)])), ("doc_tokens", totals[doc]), ("sequence_id", (part << 33) + done + number), ("offset", offset), ("segment", segment), ("loss_tokens", loss_of(start, length, totals[doc], b)), ("sequence_tokens", size), ("padded_to", size if size & (size - 1) == 0 else tokens)):
                        out[name].append(value)
                    offset += length
            done += len(found)
            ids = pa.concat_arrays(doc_ids).take(pa.array(out.pop("doc"), pa.int64()))
            return pa.RecordBatch.from_pydict({"doc_id": ids} | {k: pa.array(v, pa.int64()) for k, v in out.items()})

        for batch in gathered_batches(batches, most=ENCODE_BYTES):
            flat, at = tokenizer.encode(batch["text"])
            own = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            if answer:
                flat, then = tokenizer.encode(batch["answer"])
                own = [x + flat[a:b].tobytes() for x, a, b in zip(own, then[:-1], then[1:], strict=True)]
                bears += (np.diff(then) + 1).tolist()
                total += int(then[-1])
            else:
                bears += batch["bearing"].to_pylist()
            bodies += [x + end for x in own]
            doc_ids.append(batch["doc_id"])
            total += int(at[-1]) + batch.num_rows
            if total >= block_tokens:
                yield flush()
                doc_ids, bodies, bears, total = [], [], [], 0
        if bodies:
            yield flush()
        bodies.clear()
        trim()

    return rows.mapInArrow(sequences, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long, sequence_tokens long, padded_to long")


#: Limits for instructions: answers are short, so each of the three limits binds somewhere.
INSTRUCTIONS = {"tokens": 4096, "segments": 16, "loss": 1536}


def conversations(turns: DataFrame) -> DataFrame:
    """doc_id, text and answer of each conversation: its turns in order, and its last turn if that is the assistant's."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("all"))
    last = F.get("all", F.size("all") - 1)
    answered = F.coalesce(last["role"] == "assistant", F.lit(False))
    before = F.slice("all", F.lit(1), F.size("all") - F.when(answered, 1).otherwise(0))
    return rows.select("doc_id", F.array_join(F.transform(before, lambda x: x["line"]), "").alias("text"), F.when(answered, last["line"]).otherwise("").alias("answer"))


def packed_conversations(spark, sf_dir: str) -> DataFrame:
    """Whole conversations as instruction data: only answers bear loss, and all three limits bind."""
    return pack_documents(conversations(table(spark, sf_dir, "conversations")), answer="answer", **INSTRUCTIONS)


def op5_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
