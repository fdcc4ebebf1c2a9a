"""Ordered-series layout for window work that scales past one symbol per task.

A panel of series (one per symbol) is numbered per symbol (``_rn``, 0-based, by ts) and
cut into row blocks of ``block_rows`` (``_blk``). Every window operator then runs over
``Window.partitionBy(symbol, _blk).orderBy(_rn)``: a symbol that holds a third of all
rows is spread over many tasks instead of one.

ROWS frames that look back ``h`` rows are made exact at block starts by a *halo*: the
last ``h`` rows of block ``b`` are copied (flag ``_halo``) into block ``b+1`` through a
Generate node (no second scan of the input), used as frame input, and dropped after.

Numbering is itself parallel: rows are counted per (symbol, time chunk), the small count
table gets per-symbol prefix sums, and rows are numbered inside their chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RN = "_rn"
BLK = "_blk"
BS = "_bs"  # block size of the row, so halo arithmetic always matches ``_blk``
HALO = "_halo"

@dataclass(frozen=True)
class Layout:
    by: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    # Rows per window block: the same whatever the data and the session, so that a scan's
    # last digits never depend on either. Windows do not depend on it at all.
    block_rows: int = 4096
    # Time chunk used only while numbering rows; one chunk of one symbol is one task.
    index_chunk: str = "1 day"

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by, BLK).orderBy(RN)

    def block_size(self) -> int:
        return self.block_rows


DEFAULT_LAYOUT = Layout()


def index_rows(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add ``_rn`` (row number per series, by ts) and ``_blk`` (row block)."""
    by, ts = list(layout.by), layout.ts
    chunked = df.withColumn("_chunk", F.window(F.col(ts), layout.index_chunk).start)
    counts = chunked.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = chunked.join(offsets, [*by, "_chunk"]).withColumn(
        RN, F.col("_off") + F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(ts)) - 1
    )
    return with_blocks(numbered.drop("_chunk", "_off"), layout.block_size())


def numbered(bars: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Numbered, blocked bars materialised once: the bars are kept while numbering reads
    them twice (so the ticks behind them are aggregated once), the result is checkpointed
    to the session's checkpoint folder (lineage cut)."""
    from pyspark import StorageLevel

    from ..session import ensure_checkpoint_dir

    layout = layout or Layout()
    ensure_checkpoint_dir(bars.sparkSession)
    kept = bars.persist(StorageLevel.MEMORY_AND_DISK)
    df = index_rows(kept, layout).checkpoint(eager=True)
    kept.unpersist()
    return df


def with_blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """(Re)assign row blocks of ``block_rows`` rows: a projection, no shuffle."""
    return df.withColumn(BLK, F.floor(F.col(RN) / F.lit(block_rows))).withColumn(BS, F.lit(block_rows).cast("long"))


def with_halo(df: DataFrame, layout: Layout, halo: int, ahead: int = 0) -> DataFrame:
    """Copy each row into the neighbouring blocks that read it (flag ``_halo``):
    following blocks whose first ``halo`` look-back rows it is, and preceding blocks whose
    last ``ahead`` look-ahead rows (``lead``) it is."""
    if halo <= 0 and ahead <= 0:
        return df.withColumn(HALO, F.lit(False))
    small = layout.block_size()
    back_hops = -(-max(halo, 0) // small)
    fwd_hops = -(-max(ahead, 0) // small)
    rn, blk = F.col(RN), F.col(BLK)
    b = F.col(BS) if BS in df.columns else F.lit(layout.block_size())
    targets = F.filter(
        F.transform(
            F.sequence(F.lit(-fwd_hops), F.lit(back_hops)),
            lambda j: F.struct((blk + j).alias("b"), (j != 0).alias("h"), j.alias("j")),
        ),
        lambda t: (t["j"] == 0)
        | ((t["j"] > 0) & (rn >= t["b"] * b - F.lit(halo)))
        | ((t["j"] < 0) & (t["b"] >= 0) & (rn < (t["b"] + 1) * b + F.lit(ahead))),
    )
    return (
        df.withColumn("_tgt", F.explode(targets))
        .withColumn(BLK, F.col("_tgt.b"))
        .withColumn(HALO, F.col("_tgt.h"))
        .drop("_tgt")
    )


Step = tuple[str, Callable[[WindowSpec], Column]]


def windowed(
    df: DataFrame, layout: Layout, halo: int, levels: Iterable[Sequence[Step]], ahead: int = 0
) -> DataFrame:
    """Run window steps over blocks + halo. ``levels`` is a list of step lists: steps of
    one level are independent; a later level may use columns of earlier ones.

    All levels share one partitioning, so the plan has one exchange and one sort no
    matter how many columns are added.
    """
    w = layout.window()
    out = with_halo(df, layout, halo, ahead)
    for level in levels:
        if level:
            out = out.withColumns({name: (fn(w) if callable(fn) else fn) for name, fn in level})
    return out.filter(~F.col(HALO)).drop(HALO)


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(RN, BLK, BS)
