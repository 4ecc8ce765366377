"""The analysis of all playlists as one job.

``analyze(playlists, items, tracks)`` returns the result tables as attributes.
Nothing runs until an attribute is used. The few wide tables that several
results read are written once to the checkpoint folder (``settle``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.operators import analysis, features, kmeans, recommend
from moodloom.operators.knn import Index
from moodloom.operators.state import replace_playlists
from moodloom.operators.grouping import DEALT, deal
from moodloom.session import settle, settle_keyed, sized


class Analysis:
    """Result tables, all keyed by ``playlist_id``."""

    def __init__(
        self,
        playlists: DataFrame,
        items: DataFrame,
        tracks: DataFrame,
        assign: Callable[[DataFrame], DataFrame] | None = None,
        *,
        reads: Sequence[str] | None = None,
        max_features: int = 200,
        fraction: float = 0.15,
        rows: Callable[[], int] | None = None,
        **search,
    ):
        """``assign`` maps the library to a given (playlist_id, track_id,
        cluster_id); without it the clusters are learned with ``search``
        (arguments of ``kmeans.cluster``). ``reads`` names the columns of the library that ``assign``
        needs besides those of ``features.entries``; it then gets the entries and keeps their
        ``_salt``, and no row moves for it. ``rows`` gives about the number of ``items`` where that
        is known without work; the library is then made in as many pieces as it needs."""
        self.playlists, self.items, self.source_tracks = playlists, items, tracks
        self._assign, self._reads, self._search = assign, reads, search
        self._max_features, self._fraction, self._rows = max_features, fraction, rows

    @cached_property
    def library(self) -> DataFrame:
        with sized(self.items.sparkSession, self._rows() if self._rows else 0):
            return settle(features.library(self.items, self.source_tracks), packed=True)

    @cached_property
    def size(self) -> int:
        """Rows of the library, from the ends of its files."""
        return self.library.count()

    def sized(self):
        """For the tables below, which have a row per entry or come from such a table."""
        return sized(self.library.sparkSession, self.size)

    @cached_property
    def _dealt(self) -> tuple[DataFrame, DataFrame]:
        with self.sized():
            return features.entries(self.library, self._reads or ())

    @property
    def entries(self) -> DataFrame:
        """The rows of the library, slim, each playlist together; the steps below read them there."""
        return self._dealt[0]

    @property
    def hot(self) -> DataFrame:
        return self._dealt[1]

    @cached_property
    def model(self) -> DataFrame:
        entries = self.entries
        with self.sized():
            return settle(features.fit(entries, self._max_features))

    @cached_property
    def vectors(self) -> DataFrame:
        """Whole vectors, for the searches that need them; the analysis of clusters does not."""
        parts = self.entries, self.model, self.hot
        with self.sized():
            return settle(features.transform(*parts), packed=True)

    @cached_property
    def assignment(self) -> DataFrame:
        if self._assign is not None:
            return self._assign(self.library if self._reads is None else self.entries).drop("_salt")
        found = kmeans.cluster(
            self.vectors.select("playlist_id", "track_id", "pos", "n", "vec"), **self._search
        )
        return settle(found.select("playlist_id", "track_id", "cluster_id"))

    @cached_property
    def _placed(self) -> DataFrame:
        """The assignment alone, where the entries lie."""
        if self._reads is not None and self._assign is not None:
            found, moved = self._assign(self.entries), True
        else:
            found, moved = deal(self.assignment, self.hot), False
        found = found.filter("playlist_id IS NOT NULL").select(*DEALT, "track_id", "cluster_id")
        with self.sized():
            return settle_keyed(found, DEALT, ["track_id"], moved=moved)

    @property
    def _members(self) -> DataFrame:
        """``assigned``, joined where it is read: both sides lie together."""
        rows = self.entries.filter("eligible AND playlist_id IS NOT NULL").drop("title", "has_af", *(self._reads or ()))
        return rows.join(self._placed.hint("shuffle_hash"), [*DEALT, "track_id"])

    @cached_property
    def assigned(self) -> DataFrame:
        """Eligible entries with their cluster, for those who read them elsewhere."""
        rows = self._members
        with self.sized():
            return settle_keyed(rows, DEALT, ["track_id"], moved=True)

    @property
    def cells(self) -> DataFrame:
        """The numbers of each assigned entry that are not 0 for lack of a word, made where they are read."""
        lean = self._members.drop("eligible").withColumn("eligible", F.lit(True))
        return features.sparse(lean, self.model, self.hot).select(*DEALT, "track_id", "pos", "cluster_id", "cells")

    @cached_property
    def centers(self) -> DataFrame:
        cells = self.cells
        with self.sized():
            return settle(analysis.cluster_cells(cells, self.hot), together=True)

    @cached_property
    def distances(self) -> DataFrame:
        rows = analysis.sparse_distances(self.cells, self.centers, self.hot)
        with self.sized():
            return settle_keyed(rows, DEALT, ["track_id"], moved=True)

    @cached_property
    def scored(self) -> DataFrame:
        return analysis.scores(self.distances, self.hot)

    @cached_property
    def flagged(self) -> DataFrame:
        scored = self.scored
        with self.sized():
            ranked = analysis.flag_fraction(scored, self._fraction)
            return settle_keyed(ranked.drop("distance", "max_distance", "n"), DEALT, ["track_id"], moved=True)

    @cached_property
    def clusters(self) -> DataFrame:
        """Every cluster with size, means, ``kept`` and label."""
        members = self._members
        with self.sized():
            return settle(analysis.label_clusters(analysis.audio_means(members)), together=True)

    @cached_property
    def top_tags(self) -> DataFrame:
        return settle(analysis.top_words(self.centers, self.model))

    @cached_property
    def dealt_tracks(self) -> DataFrame:
        """``tracks`` where the playlists lie together, for ranks and pages within them."""
        whole = analysis.track_analysis(self.entries, self.flagged, self.clusters, self.hot)
        with self.sized():
            return settle_keyed(whole, DEALT, ["track_id"], moved=True)

    @cached_property
    def tracks(self) -> DataFrame:
        """One row per playlist entry: cluster, score, flag and reason."""
        return self.dealt_tracks.drop("_salt")

    @cached_property
    def kept(self) -> DataFrame:
        return self.clusters.filter("kept")

    @cached_property
    def moods(self) -> DataFrame:
        return analysis.moods(self.clusters)

    @cached_property
    def mood_tracks(self) -> DataFrame:
        return analysis.mood_index(self.tracks)

    @cached_property
    def distribution(self) -> DataFrame:
        return analysis.mood_distribution(self.clusters)

    @cached_property
    def summary(self) -> DataFrame:
        return analysis.summary(self.playlists, self.tracks, self.flagged, self.clusters)

    @cached_property
    def excluded(self) -> DataFrame:
        return analysis.excluded(self.tracks)

    @cached_property
    def catalog(self) -> Index:
        """Index of the audio features of all tracks, for nearest-neighbour searches."""
        return Index(recommend.catalog_vectors(self.source_tracks))

    @cached_property
    def seeded(self) -> DataFrame:
        """Members of the clusters that feed the recommender, where the entries lie."""
        return recommend.members_in_place(self.dealt_tracks, recommend.label_clusters(self.clusters), self.hot)

    @cached_property
    def asked(self) -> DataFrame:
        """(playlist_id, cluster_id, chunk, vec): the mean vector of each chunk of seeds."""
        inside = self.seeded
        with self.sized():
            found = recommend.chunk_vectors_in_place(inside, self.entries, self.source_tracks, self.hot)
            if found is None:
                catalog = recommend.catalog_vectors(self.source_tracks)
                found = recommend.asked_vectors(recommend.chunks(recommend.seeds(inside)), inside, catalog)
            return settle(found, together=True)

    @cached_property
    def recommendations(self) -> DataFrame:
        """A track for every five seeds of every cluster."""
        found = self.asked, self.seeded
        return settle(recommend.recommend(self.tracks, self.clusters, self.source_tracks, index=self.catalog, found=found))


def analyze(playlists: DataFrame, items: DataFrame, tracks: DataFrame, **params) -> Analysis:
    return Analysis(playlists, items, tracks, **params)


def refresh(saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """A saved result table after some playlists were analysed again: their
    rows are replaced, all others stay. Analyse the playlists that
    ``state.changed_playlists`` marks ``fetch`` and refresh the rest with it."""
    return replace_playlists(saved, fresh, ("playlist_id",))


def aggregate(items: DataFrame) -> DataFrame:
    """All playlists as one virtual playlist, first occurrence of a track kept."""
    first = items.groupBy("track_id").agg(
        F.min(F.struct("playlist_id", "pos")).alias("_f"),
    )
    return first.select(
        F.lit("aggregated").alias("playlist_id"),
        "track_id",
        F.col("_f.pos").alias("pos"),
        F.col("_f.playlist_id").alias("from_playlist_id"),
    )
