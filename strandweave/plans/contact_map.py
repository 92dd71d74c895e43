"""The whole pipeline over one immutable map: build, accept, normalise, balance, reduce, cluster, order, report.

Every step gives new tables; nothing that a call leaves behind changes what a later call sees.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..config import MapConfig
from ..operators import bins, community, contacts, graph, masks, normalise, order_state, ordering, reports, subspace
from ..operators.balance import balanced, balanced_tips


@dataclass(frozen=True)
class ContactMap:
    """sequences, pairs with their status, contacts (upper triangle; by tips with config.tip_size), and extents over bins with config.bin_size."""

    config: MapConfig
    sequences: DataFrame
    pairs: DataFrame
    contacts: DataFrame
    tips: DataFrame | None = None
    grouped: DataFrame | None = None
    extents: DataFrame | None = None

    @classmethod
    def build(cls, alignments: DataFrame, references: DataFrame, fasta: DataFrame, config: MapConfig, order: list[str]) -> ContactMap:
        """alignments in name groups, in this order within a name; fasta: counted sequences (name, length, sites...)."""
        seqs = contacts.sequence_table(references, fasta, config.min_len)
        pairs = contacts.classified(contacts.paired(contacts.informative(alignments), order), seqs, config)
        tips = contacts.counted_tips(pairs) if config.tip_based else None
        counted = subspace.marginalised(tips) if config.tip_based else contacts.counted(pairs)
        grouped = bins.grouped_bins(seqs, config.bin_size) if config.bin_size else None
        extents = contacts.counted_extents(pairs, grouped) if config.bin_size else None
        return cls(config, seqs, pairs, counted, tips, grouped, extents)

    def statuses(self) -> DataFrame:
        return contacts.status_counts(self.pairs)

    def weight(self) -> int:
        return contacts.map_weight(self.contacts).first()[0]

    def is_empty(self) -> bool:
        return contacts.is_empty(self.contacts)

    def appended(self, other: ContactMap) -> ContactMap:
        """Both maps' counts; an error if their sequences or configurations differ."""
        if self.config != other.config or not contacts.same_sequences(self.sequences, other.sequences):
            raise ValueError("maps of different sequences or configurations can't be added")
        both = lambda a, b: contacts.added(a, b) if a is not None else None
        return replace(self, pairs=self.pairs.unionByName(other.pairs), contacts=contacts.added(self.contacts, other.contacts), tips=both(self.tips, other.tips), extents=both(self.extents, other.extents))

    def mask(self, min_len: int | None = None, min_signal: float | None = None) -> DataFrame:
        """Acceptance by length and by the largest contact with another sequence."""
        signal = masks.max_off_diagonal(self.contacts, self.sequences)
        return masks.acceptance(self.sequences, signal, self.config.min_len if min_len is None else min_len, self.config.min_signal if min_signal is None else min_signal)

    def state(self, mask: DataFrame | None = None) -> DataFrame:
        return order_state.with_mask(order_state.initial(self.sequences), self.mask() if mask is None else mask)

    def processed(self, norm: bool = True, bisto: bool = True, mean: str | None = None) -> DataFrame:
        """The whole map normalised by sites (by lengths with a mean), then balanced, before anything is masked."""
        if self.config.tip_based:
            rows = self.tips.withColumnRenamed("n", "value")
            if norm:
                rows = normalise.tips_by_length(self.tips, self.sequences, self.config.tip_size) if mean else normalise.tips_by_sites(self.tips, self.sequences)
            return balanced_tips(rows)[0] if bisto else rows
        rows = self.contacts.withColumnRenamed("n", "value")
        if norm:
            rows = normalise.by_length(self.contacts, self.sequences, mean) if mean else normalise.by_sites(self.contacts, self.sequences)
        return balanced(rows)[0] if bisto else rows

    def subspace(self, processed: DataFrame, mask: DataFrame | None = None, marginalise: bool = False, flatten: bool = False, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(cells under dense ids, accepted ids): masked, then tips added up or laid out; permuted by an order (dense id, rank) if there is one."""
        if marginalise and flatten:
            raise ValueError("tips are added up or laid out, not both")
        accepted = masks.accepted_ids(self.mask() if mask is None else masks.intersected(self.mask(), mask), check=True)
        rows = masks.compressed(processed, accepted)
        if self.config.tip_based:
            if marginalise:
                rows = subspace.marginalised(rows, "value")
            elif flatten:
                rows = subspace.flattened(rows, "value")
            elif order is not None:
                raise ValueError("a tip table is added up or laid out before it is permuted")
        if order is not None:
            rows = subspace.permuted(rows, subspace.doubled_order(order) if flatten else order, full=False)
        return rows, accepted

    def extent_map(self, norm: bool = True, bisto: bool = False, mean: str = "geometric", order: DataFrame | None = None) -> DataFrame:
        """Bin contacts normalised by lengths, masked, balanced after that, and permuted by (seq_id, rank, ori)."""
        table = bins.bin_table(self.grouped)
        rows = normalise.extents_by_length(self.extents, table, self.sequences, mean) if norm else self.extents.withColumnRenamed("n", "value")
        accepted = masks.accepted_ids(self.mask(), check=True)
        if order is not None:
            at = subspace.bin_order(self.grouped.join(accepted.select("seq_id"), "seq_id", "left_semi"), order)
            rows = subspace.permuted(rows, at, "bi", "bj", full=False)
        else:
            rows = masks.compressed_extents(rows, masks.dense_bins(self.grouped, accepted))
        if bisto:
            named = rows.withColumnsRenamed({"bi": "i", "bj": "j"})
            rows = balanced(named)[0].withColumnsRenamed({"i": "bi", "j": "bj"})
        return rows

    def graph(self, norm: bool = True, bisto: bool = True, scale: bool = True, drop_self_loops: bool = False) -> DataFrame:
        """Edges between sequence ids of the processed, masked map."""
        rows, accepted = self.subspace(self.processed(norm, bisto), marginalise=self.config.tip_based)
        for x in ("i", "j"):
            rows = masks.expanded(rows.withColumnRenamed(x, "dense_id"), accepted).withColumnRenamed("seq_id", x)
        return graph.edge_graph(rows.select("i", "j", "value"), scale, drop_self_loops)

    def clusters(self, method: str = "infomap", seed: int = 0, prefix: str = "CL", **more) -> tuple[DataFrame, DataFrame]:
        """(clusters, members), the largest extent first."""
        found = community.clustered(self.graph(), method, seed, **more)
        members = found.select(found["cl_id"].cast("int").alias("cl_id"), found["node"].cast("int").alias("seq_id"))
        return reports.ranked_clusters(members, self.sequences, prefix)

    def ordered(self, clusters: DataFrame, members: DataFrame, seed: int = 0, **more) -> DataFrame:
        """(cl_id, rank, seq_id, ori) of all eligible clusters, a task each."""
        return ordering.ordered_clusters(self.processed(), members, clusters, seed, tips=self.config.tip_based, **more)
