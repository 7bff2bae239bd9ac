"""The whole run in order: land new files, flatten, keep the latest, build the star, check it, serve it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import quality
from strata.sources import drift
from strata.sources.buckets import BucketStore
from strata.sources.schemas import MATTER, MEETING
from strata.sources.sinks import Layers, as_view, remove, stored
from strata.streaming.landing import Landed, batches, compact, land_all, landed
from strata.streaming.log import BatchLog

from .incremental import VERSION, Changes, gold, in_force, latest
from .serve import member_vote_record
from .staging import SILVER
from .star import ENTITIES, Tables, build_gold, latest_captures, merged_rows

ZONES = {"matters": MATTER, "meetings": MEETING}
#: What lies in bronze: the declared fields, and what they have no place for.
BRONZE = {zone: f"{ddl}, {drift.REST} {drift.REST_TYPE}" for zone, ddl in ZONES.items()}
KEYS = {entity: key for entity, key, _ in ENTITIES}


@dataclass
class Run:
    """Where a run keeps its things: ``raw`` has the landing zones matters/ and meetings/, ``work`` everything written."""

    spark: SparkSession
    raw: str
    work: str
    prefix: str = ""
    compat: bool = False
    buckets: int = 64
    landed: dict[str, Landed] = field(default_factory=dict)

    def _paths(self, name: str) -> dict:
        return {"source": f"{self.raw}/{name}", "target": f"{self.work}/bronze/{name}", "checkpoint": f"{self.work}/checkpoints/{name}", "quarantine": f"{self.work}/quarantine/{name}"}

    def ingest(self) -> dict[str, Landed]:
        streams = {"matters": {"ddl": MATTER, "key": "file_number"}, "meetings": {"ddl": MEETING, "key": "meeting_id"}}
        self.landed = land_all(self.spark, {n: {**s, **self._paths(n), "keep_rest": True} for n, s in streams.items()})
        return self.landed

    def compact(self) -> dict[str, int]:
        """Packs the small files that landing leaves, and removes what earlier packing and failed batches left; not while ``ingest`` runs."""
        packed = {zone: compact(self.spark, f"{self.work}/bronze/{zone}", ddl) for zone, ddl in BRONZE.items()}
        for zone in ZONES:
            BatchLog(self.spark, f"{self.work}/bronze/{zone}").vacuum()
        return packed

    def withdraw(self, zone: str, rows: DataFrame) -> None:
        """Entities that the source no longer has: their key (matter_file or meeting_id), and when and where that was seen (ingest_date,
        loaded_at, source_file). A capture after that brings one back.
        """
        name, target = f"batch={uuid.uuid4().hex}", f"{self.work}/withdrawn/{zone}"
        written = stored(rows, f"{target}/{name}")
        BatchLog(self.spark, target).record(name, written.select("source_file").distinct())

    def _withdrawn(self, silver: Tables, only: dict[str, list[str]] | None = None) -> Tables:
        out: Tables = {}
        for zone, key in KEYS.items():
            base = f"{self.work}/withdrawn/{zone}"
            names = batches(self.spark, base) if only is None else only[zone]
            if names:
                lineage = [f for f in silver[f"stg_{zone}"].schema if f.name in (key, *VERSION)]
                out[f"stg_{zone}"] = self.spark.read.schema(T.StructType(lineage)).parquet(*(f"{base}/{n}" for n in names))
        return out

    def transform(self) -> dict[str, DataFrame]:
        """Silver and the latest captures are tables, so each is computed once however many models read it."""
        layers = Layers(self.spark, self.prefix)
        bronze = {n: landed(self.spark, f"{self.work}/bronze/{n}", d) for n, d in ZONES.items()}
        silver = {name: layers.materialise(build(bronze[source]), "silver", name, ("ingest_date",)) for name, (source, build) in SILVER.items()}
        latest = latest_captures(in_force(silver, self._withdrawn(silver)), lambda name, df: layers.materialise(df, "silver", name))
        gold = {name: layers.materialise(df, "gold", name) for name, df in build_gold(latest, self.compat).items()}
        return {**silver, **latest, **gold, "member_vote_record": as_view(member_vote_record(gold), "member_vote_record")}

    def refresh(self) -> Tables:
        """The same tables as ``transform``, from what has landed or been withdrawn since the last refresh.

        A refresh reads only new bronze, adds a part to each silver table, and sends what its captures change through the models
        (``incremental``): of the latest captures and of gold only those buckets are read and written that hold a key it
        touches. All tables and the list of what was applied become visible by one commit: a refresh that fails before is
        done again by the next one. The list has a row for each batch, so it is small.
        """
        store = BucketStore(self.spark, f"{self.work}/star", self.buckets)
        done, parts = store.notes.get("applied", []), store.notes.get("parts", [])
        found = {f"{base}/{zone}": batches(self.spark, f"{self.work}/{base}/{zone}") for zone in ZONES for base in ("bronze", "withdrawn")}
        new = {at: [b for b in names if f"{at}/{b}" not in set(done)] for at, names in found.items()}
        bronze = {zone: landed(self.spark, f"{self.work}/bronze/{zone}", ddl, new[f"bronze/{zone}"]) for zone, ddl in ZONES.items()}
        rows = {name: build(bronze[source]) for name, (source, build) in SILVER.items()}
        if any(new.values()) or not parts:
            part = uuid.uuid4().hex
            silver = {name: stored(df, f"{self.work}/silver/{name}/part={part}") for name, df in rows.items()}
            changes = f"{self.work}/changes/{part}"
            Changes(store, lambda name, df: stored(df, f"{changes}/{name}"), self.compat).apply(silver, self._withdrawn(silver, {z: new[f"withdrawn/{z}"] for z in ZONES}))
            parts, tables = [*parts, part], self._gold(store)
            store.commit(applied=[*done, *(f"{at}/{b}" for at, names in new.items() for b in names)], parts=parts)
            remove(self.spark, changes)
            store.vacuum()
        else:
            tables = self._gold(store)
        silver = {name: self.spark.read.schema(df.schema).parquet(*(f"{self.work}/silver/{name}/part={p}" for p in parts)) for name, df in rows.items()}
        return {**silver, **latest(store), **tables}

    def _gold(self, store: BucketStore) -> Tables:
        tables = gold(store)
        return {**tables, "member_vote_record": as_view(member_vote_record(tables), "member_vote_record")}

    def _bronze(self, zone: str) -> DataFrame:
        return landed(self.spark, f"{self.work}/bronze/{zone}", BRONZE[zone])

    def drift(self) -> DataFrame:
        """zone, path, problem, n_records, n_values of what has landed beside the declared fields."""
        return quality.report(*(drift.drift_report(self._bronze(z).select(F.lit(z).alias("zone"), drift.REST), "zone") for z in ZONES))

    def check(self, tables: dict[str, DataFrame]) -> DataFrame:
        t = tables
        return quality.report(
            quality.orphans(t["fact_matter_action"], "matter_sk", t["dim_matter"], "matter_sk", "fact_matter_action"),
            quality.orphans(t["fact_vote"], "person_sk", t["dim_person"], "person_sk", "fact_vote"),
            quality.orphans(t["fact_vote"], "meeting_sk", t["dim_meeting"], "meeting_sk", "fact_vote"),
            quality.orphans(t["bridge_matter_sponsor"], "person_sk", t["dim_person"], "person_sk", "bridge_matter_sponsor"),
            quality.orphans(t["bridge_matter_document"], "document_sk", t["dim_document"], "document_sk", "bridge_matter_document"),
            quality.unmapped(t["dim_matter"], "lifecycle", "dim_matter"),
            quality.unresolved(t["bridge_matter_sponsor"], "person_sk", "bridge_matter_sponsor"),
            quality.collisions(t["dim_person"].where("person_id IS NOT NULL"), "full_name", "person_id", "dim_person"),
            quality.orphans(t["bridge_meeting_document"], "document_sk", t["dim_document"], "document_sk", "bridge_meeting_document"),
            quality.unique(t["fact_vote"], ["vote_sk"], "fact_vote"),
            merged_rows(t),
            *(quality.drifted(self._bronze(zone), zone) for zone in ZONES),
            quality.no_fan_out(t["member_vote_record"], t["fact_vote"], "member_name", "member_vote_record"),
        )

    def reset(self) -> None:
        """Forget everything that was written; the next run replays the landing zones from the start."""
        Layers(self.spark, self.prefix).reset("silver", "gold")
        remove(self.spark, self.work)
