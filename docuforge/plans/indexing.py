"""The write path: read, compare, chunk, write a new snapshot, embed what is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.functions.chunking import chunk_files
from docuforge.functions.text import content_hash, file_type, word_count
from docuforge.operators.changes import cascade, in_scope, latest, missing_embeddings, upsert_actions, vanished
from docuforge.operators.lexical import build_index
from docuforge.sources.store import Store

#: A file is read anew where one of these differs: content, kind, date, or how it is to be cut into chunks.
COMPARED = ["hash", "size_bytes", "file_type", "modified_at", "chunked_by"]
EMBEDDINGS = "profile_hash string, chunk_id bigint, hash string, vector array<float>"
POSTINGS, STATS = "term string, chunk_id bigint, tf bigint", "chunk_id bigint, dl bigint"
IMAGES = "image_id bigint, file_id bigint, hash string, size_bytes bigint"
IMAGE_FILES = "file_id bigint, path string, content string, file_type string"
IMAGE_EMBEDDINGS = "profile_hash string, image_id bigint, hash string, vector array<float>"


@dataclass(frozen=True)
class Options:
    chunking: str = "smart"  # smart, line-window, off
    store_full_files: bool = True
    store_chunks: bool = True
    scope: str = ""
    target_tokens: int = 450
    max_tokens: int = 900
    overlap_tokens: int = 80
    min_chunk_chars: int = 80

    @property
    def chunked_by(self) -> str:
        """What decides the chunks of a file besides its content."""
        if not self.store_chunks:
            return "none"
        sizes = (self.target_tokens, self.max_tokens, self.overlap_tokens, self.min_chunk_chars)
        return ":".join(map(str, (self.chunking, *sizes))) if self.chunking == "line-window" else self.chunking


def as_files(texts: DataFrame, o: Options = Options()) -> DataFrame:
    """(file_id, path, hash, size_bytes, modified_at, file_type, chunked_by, content) from (path, text[, modified_at]).

    Ids are hashes of the path, so runs agree without a counter.
    """
    when = F.col("modified_at").cast("string") if "modified_at" in texts.columns else F.lit(None).cast("string")
    return texts.select(
        F.xxhash64("path").alias("file_id"), "path", content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"), when.alias("modified_at"),
        file_type(F.col("path")).alias("file_type"), F.lit(o.chunked_by).alias("chunked_by"), F.col("text").alias("content"),
    )


def stored_files(store: Store, schema) -> DataFrame:
    """The files of the index; columns that an older one lacks are null."""
    found = store.read("files", schema)
    return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def as_chunks(files: DataFrame, o: Options) -> DataFrame:
    window = {"target": o.target_tokens, "most": o.max_tokens, "overlap": o.overlap_tokens, "min_bytes": o.min_chunk_chars} if o.chunking == "line-window" else {}
    c = chunk_files(files, o.chunking, keep=["file_id", "path"], **window)
    return c.select(F.xxhash64("path", "chunk_index").alias("chunk_id"), "*", content_hash(F.col("text")).alias("hash"), word_count(F.col("text")).cast("long").alias("token_count"))


def plan_changes(store: Store, new: DataFrame, o: Options) -> DataFrame:
    """(path, action) of the files in scope."""
    old = stored_files(store, new.schema).where(in_scope(F.col("path"), o.scope))
    return upsert_actions(old, new, "path", COMPARED)


def dry_run(store: Store, new: DataFrame, o: Options) -> dict[str, int]:
    """Counts by action, without writing."""
    return {r["action"]: r["count"] for r in plan_changes(store, new, o).groupBy("action").count().collect()}


def index(store: Store, texts: DataFrame, o: Options = Options(), upsert: bool = False) -> dict[str, int]:
    """Bring the store in line with ``texts`` (path, text[, modified_at]); returns discovered, changed and removed.

    Only changed files are chunked and only their chunks are put into the postings; files whose way of chunking
    changed count as changed.  Children of files that are gone or changed go with them.  With ``upsert`` no file is gone:
    ``texts`` are additions and replacements.  All tables change in one commit: readers see the old or the new snapshot.
    """
    change = store.begin()
    new = as_files(texts.where("text is not null"), o)
    actions = plan_changes(store, new, o)
    actions = change.hold("actions", actions.where("action <> 'missing'") if upsert else actions)
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    changed = new.join(actions.where("action in ('insert', 'update')").select("path"), "path", "left_semi")
    renewed = change.hold("renewed", changed.select("file_id"))

    old_files = stored_files(store, new.schema).join(actions.where("action = 'missing'").select("path"), "path", "left_anti")
    stored = changed if o.store_full_files else changed.withColumn("content", F.lit(None).cast("string"))
    files = change.put("files", latest(old_files, stored.select(*old_files.columns), ["path"]))
    made = as_chunks(changed, o)
    if not o.store_chunks:
        made = made.limit(0)
    kept = cascade(store.read("chunks", made.schema), files, "file_id").join(renewed, "file_id", "left_anti")
    chunks = change.put("chunks", kept.unionByName(made))
    still, fresh = chunks.join(renewed, "file_id", "left_anti").select("chunk_id"), chunks.join(renewed, "file_id", "left_semi")
    postings, stats = build_index(fresh)
    change.put("postings", cascade(store.read("postings", POSTINGS), still, "chunk_id").select("term", "chunk_id", "tf").unionByName(postings))
    change.put("stats", cascade(store.read("stats", STATS), still, "chunk_id").select("chunk_id", "dl").unionByName(stats))
    change.put("embeddings", store.read("embeddings", EMBEDDINGS).join(chunks.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_semi"))
    change.commit()
    return {"discovered": sum(n for a, n in counts.items() if a != "missing"), "changed": counts.get("insert", 0) + counts.get("update", 0), "removed": counts.get("missing", 0)}


def index_images(store: Store, found: DataFrame, scope: str = "") -> dict[str, int]:
    """Bring the images of the store in line with ``found`` (path, content binary); returns discovered, changed and removed.

    Images in scope that were not found go, with their vectors; vectors of changed images go.  Ids are hashes of the path.
    """
    change = store.begin()
    new = found.select(F.xxhash64("path").alias("file_id"), "path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size_bytes"), file_type(F.col("path")).alias("file_type"))
    new = change.hold("images", new)
    held = store.read("image_files", IMAGE_FILES)
    old = held.join(store.read("images", IMAGES).select("file_id", "hash"), "file_id")
    actions = change.hold("image-actions", upsert_actions(old.where(in_scope(F.col("path"), scope)), new, "path", ["hash"]))
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    outside = old.join(actions.select("path"), "path", "left_anti").select("file_id")
    rows = new.select(F.col("file_id").alias("image_id"), "file_id", "hash", "size_bytes")
    images = change.put("images", cascade(store.read("images", IMAGES), outside, "file_id").select(*rows.columns).unionByName(rows))
    files = new.select("file_id", "path", F.lit(None).cast("string").alias("content"), "file_type")
    change.put("image_files", cascade(held, outside, "file_id").select(*files.columns).unionByName(files))
    vectors = store.read("image_embeddings", IMAGE_EMBEDDINGS)
    change.put("image_embeddings", vectors.join(images.select("image_id", "hash"), ["image_id", "hash"], "left_semi").select(*vectors.columns))
    change.commit()
    return {"discovered": sum(n for a, n in counts.items() if a != "missing"), "changed": counts.get("insert", 0) + counts.get("update", 0), "removed": counts.get("missing", 0)}


def missing_images(images: DataFrame, vectors: DataFrame, profile_hash: str) -> DataFrame:
    """Images without a vector of the profile for the content they have."""
    have = vectors.where(F.col("profile_hash") == profile_hash)
    return images.join(have.select("image_id", "hash"), ["image_id", "hash"], "left_anti")


def embed_missing_images(store: Store, contents: DataFrame, provider, profile_hash: str, batch: int = 16) -> dict[str, int]:
    """Embed the images without a vector from ``contents`` (path, content); returns how many were embedded and how many failed.

    Images that fail stay missing and are tried again on the next run.
    """
    from docuforge.providers import embed_images

    change = store.begin()
    vectors = store.read("image_embeddings", IMAGE_EMBEDDINGS)
    todo = missing_images(store.read("images", IMAGES), vectors, profile_hash).select("image_id", "hash")
    bodies = contents.select(F.xxhash64("path").alias("image_id"), "content")
    made = change.hold("image-vectors", embed_images(todo.join(bodies, "image_id"), provider, ["image_id", "hash"], batch))
    good = made.where("error is null").select(F.lit(profile_hash).alias("profile_hash"), "image_id", "hash", "vector")
    change.put("image_embeddings", latest(vectors, good, ["profile_hash", "image_id"]))
    n = made.groupBy(F.col("error").isNull().alias("ok")).count().collect()
    change.commit()
    counts = {r["ok"]: r["count"] for r in n}
    return {"embedded": counts.get(True, 0), "failed": counts.get(False, 0)}


def embed_missing(store: Store, provider, batch: int = 64) -> int:
    """Embed chunks that have no vector in the provider's profile; returns how many there were."""
    from docuforge.providers import embed_frame

    profile = provider.profile.hash
    embeddings = store.read("embeddings", EMBEDDINGS)
    todo = missing_embeddings(store.read("chunks").select("chunk_id", "hash", "text"), embeddings, F.col("profile_hash") == profile)
    vectors = embed_frame(todo, provider, "text", ["chunk_id", "hash"], batch).select(F.lit(profile).alias("profile_hash"), "chunk_id", "hash", "vector")
    before = embeddings.count()
    store.write({"embeddings": latest(embeddings, vectors, ["profile_hash", "chunk_id"])})
    return store.read("embeddings").count() - before


def remove(store: Store, path: str) -> int:
    """Remove a file or everything below a folder; returns the number of files removed."""
    files = store.read("files")
    path = path.replace("\\", "/").removeprefix("./").rstrip("/")
    keep = files.where(~in_scope(F.col("path"), path))
    gone = files.count() - keep.count()
    if gone:
        chunks = cascade(store.read("chunks"), keep, "file_id")
        embeddings = store.read("embeddings", EMBEDDINGS)
        stats, postings = store.read("stats"), store.read("postings")
        store.write({"files": keep, "chunks": chunks, "embeddings": cascade(embeddings, chunks, "chunk_id"), "stats": cascade(stats, chunks, "chunk_id"), "postings": cascade(postings, chunks, "chunk_id")})
    return gone
