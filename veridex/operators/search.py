"""The two paths of search over the stored indexes, for whole tables of requests.

What a request may read is asked of the tables as they are now: generations, versions, documents, profiles, members and lists. The
indexes hold only what can't change: which term stands where in a chunk, and a chunk's vector under a profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.run import BUILT, Tables, apply
from ..plans.shared import kept, shared_folder
from .analysis import Segmenter, terms, words
from .covers import cover_score
from .postings import Postings
from .retrieval import ASKED, MAY_READ, READY_GENERATION, TOP
from .vectors import VectorBlocks

DIRECTORY = "chunk_id long, generation_id long, version_id long, document_id long, chunk_index long, line_no long, profile_id long"


@dataclass(frozen=True)
class SearchIndex:
    """Postings, vector blocks and the directory of chunks (DIRECTORY) of a folder."""

    path: str
    postings: Postings
    vectors: VectorBlocks

    @staticmethod
    def at(tables: Tables, path: str) -> SearchIndex:
        return SearchIndex(path, Postings(tables.spark, f"{path}/postings"), VectorBlocks(tables.spark, f"{path}/vectors"))

    def append(self, chunks: DataFrame, embeddings: DataFrame, name: str, segment: Segmenter = words) -> None:
        """Adds the chunks of finished generations (DIRECTORY's columns but profile_id, and text) that have an embedding
        (chunk_id, profile_id, embedding), in order of the parts, the directory last: only what it names is found."""
        whole = kept(chunks.join(embeddings.select("chunk_id", "profile_id", "embedding"), "chunk_id"))
        self.postings.append(whole.select("chunk_id", "text"), name, segment)
        self.vectors.append(whole.select("chunk_id", "embedding"), name)
        self.append_directory(whole.drop("profile_id"), whole, name)

    def append_directory(self, chunks: DataFrame, embeddings: DataFrame, name: str) -> None:
        rows = chunks.join(embeddings.select("chunk_id", "profile_id"), "chunk_id").select(*[c.split()[0] for c in DIRECTORY.split(", ")])
        rows.write.mode("errorifexists").parquet(f"{self.path}/chunks/segment={name}")

    def directory(self) -> DataFrame:
        return self.postings.spark.read.schema(f"{DIRECTORY}, segment string").parquet(f"{self.path}/chunks").drop("segment")


def keyword_match(tables: Tables, index: SearchIndex, least: float = 0.0) -> DataFrame:
    """(request_id, chunk_id, places) of chunks that hold all terms of a request (@query_term) and that it may read."""
    hit = index.postings.match(tables["query_term"], least)
    named = {n: tables[n] for n in ("request_kb", "knowledge_base", "kb_member", "index_profile", "user_account", "index_generation", "document_version", "document", "document_acl")}
    # an id that chunks of two documents have is found once
    text = f"""SELECT DISTINCT h.request_id, h.chunk_id, h.places FROM @hit h JOIN @indexed_chunk c ON c.chunk_id = h.chunk_id JOIN ({READY_GENERATION}) r ON r.generation_id = c.generation_id AND r.profile_id = c.profile_id
        JOIN ({ASKED}) q ON q.request_id = h.request_id AND q.kb_id = r.kb_id WHERE {MAY_READ}"""
    return apply(tables.spark, lambda _: text, named | {"hit": hit, "indexed_chunk": index.directory()})


def vector_top(tables: Tables, index: SearchIndex, k: int = TOP) -> DataFrame:
    """(request_id, chunk_id, score, rank): the best chunks of each request that it may read. Chunks of a base are one unit, but
    those of a document with a list of its own, which are another."""
    spark = tables.spark
    ready = apply(spark, lambda _: READY_GENERATION, tables)
    own = F.when(F.col("acl_mode") != "INHERIT", F.col("document_id")).otherwise(F.lit(-1))
    unit = F.concat_ws("/", "kb_id", own).alias("unit")
    chunks = index.directory().select("chunk_id", "generation_id", "profile_id").join(ready.select("generation_id", "profile_id", unit), ["generation_id", "profile_id"])
    live = chunks.join(index.vectors.places(), "chunk_id").select("block", "place", "unit")
    asked = kept(apply(spark, lambda _: ASKED, tables))
    listed = ready.where("acl_mode <> 'INHERIT'").select("kb_id", "document_id").distinct().join(tables["document_acl"].select("document_id", "user_id").distinct(), "document_id")
    may = asked.select("request_id", F.concat_ws("/", "kb_id", F.lit(-1)).alias("unit")).unionByName(asked.join(listed, ["kb_id", "user_id"]).select("request_id", F.concat_ws("/", "kb_id", "document_id").alias("unit")))
    return index.vectors.top_k(tables["search_request"].select("request_id", "embedding"), live, may.distinct(), k)


#: Folders of indexes that this process has begun, by session and by the files they are built from, and the parts that are there.
_built: dict[tuple, str] = {}
_parts: set[tuple[str, str]] = set()


def _version(tables: Tables, *names: str) -> tuple:
    """What tells whether the files of these tables are still those that an index was built from."""
    jvm, conf = tables.spark.sparkContext._jvm, tables.spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        for file in sorted(tables[name].inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(conf).getFileStatus(path)
            out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def stored_index(tables: Tables, *parts: str) -> SearchIndex:
    """The index of the derived chunks in the folder that all executors share. Each of the named parts (chunks, postings, vectors) is
    built when a query of the session first asks for it, so none pays for what it doesn't read."""
    key = (tables.spark.sparkContext.applicationId, *_version(tables, "documents", "embeddings"))
    index = SearchIndex.at(tables, _built.setdefault(key, shared_folder(tables.spark, "index")))
    build = {
        "chunks": lambda: index.append_directory(tables["chunk"], tables["chunk_embedding"], "all"),
        # of all chunks: those without an embedding aren't in the directory
        "postings": lambda: index.postings.append(tables["chunk"].select("chunk_id", F.col("line").alias("text")), "all"),
        "vectors": lambda: index.vectors.append(tables["chunk_embedding"].select("chunk_id", "embedding"), "all"),
    }
    for part in parts:
        if (index.path, part) not in _parts:
            build[part]()
            _parts.add((index.path, part))
    return index


def _postings(tables: Tables) -> DataFrame:
    rows = stored_index(tables, "postings").postings.decode()
    return rows.select("term", "chunk_id", F.size("places").cast("long").alias("tf"), F.array_join(F.col("places").cast("array<string>"), ",").alias("positions"))


def _keyword_score(tables: Tables) -> DataFrame:
    return tables["keyword_match"].select("request_id", "chunk_id", cover_score("places").alias("s")).select("request_id", "chunk_id", "s.covers", F.round("s.score", 9).alias("score"))


def canary_found(tables: Tables, index: SearchIndex) -> DataFrame:
    """(item_id) of canaries (item_id, canary) that stand, letter by letter, in a chunk of an active version that the item's
    request may name and its user may read.

    A canary may begin and end within a word, so only its inner terms are looked up; the chunks that hold them are read. A canary
    without inner terms is looked for in all chunks of its bases."""
    inner = F.split(F.regexp_replace("canary", r"^\S*|\S*$", " "), r"\s+")
    named = tables["canary"].where("canary <> ''").select("item_id", "canary", F.array_distinct(terms(F.array_join(inner, " "))).alias("terms"))
    with_terms = named.where(F.size("terms") > 0)
    hit = index.postings.match(with_terms.select(F.col("item_id").alias("request_id"), F.explode("terms").alias("term"))).select(F.col("request_id").alias("item_id"), "chunk_id")
    used = {n: tables[n] for n in ("request_kb", "knowledge_base", "kb_member", "user_account", "document", "chunk")}
    open_bases = """SELECT q.request_id AS item_id, q.kb_id FROM @request_kb q JOIN @kb_member m ON m.kb_id = q.kb_id AND m.user_id = q.user_id AND NOT m.revoked JOIN @knowledge_base k ON k.kb_id = q.kb_id
        JOIN @user_account u ON u.user_id = q.user_id AND u.organization_id = k.organization_id"""
    active = "@chunk c JOIN @document x ON x.document_id = c.document_id AND NOT x.deleted AND x.active_version_id = c.version_id"
    # chunks are found by their ids; lines are read for these only
    text = f"SELECT DISTINCT h.item_id, h.chunk_id FROM @hit h JOIN (SELECT c.chunk_id, x.kb_id FROM {active}) c ON c.chunk_id = h.chunk_id JOIN ({open_bases}) b ON b.item_id = h.item_id AND b.kb_id = c.kb_id"
    near = kept(apply(tables.spark, lambda _: text, used | {"hit": hit}))
    read = "SELECT DISTINCT h.item_id FROM @near h JOIN @named y ON y.item_id = h.item_id JOIN @chunk c ON c.chunk_id = h.chunk_id WHERE contains(c.line, y.canary)"
    found = apply(tables.spark, lambda _: read, {"near": near, "named": with_terms, "chunk": tables["chunk"]})
    bare = named.where(F.size("terms") == 0)
    if bare.isEmpty():
        return found
    everywhere = f"SELECT DISTINCT y.item_id FROM @bare y JOIN ({open_bases}) b ON b.item_id = y.item_id JOIN (SELECT c.line, x.kb_id FROM {active}) c ON c.kb_id = b.kb_id AND contains(c.line, y.canary)"
    return found.union(apply(tables.spark, lambda _: everywhere, used | {"bare": bare})).distinct()


BUILT.update(
    {
        "ranked_kept": lambda tables: kept(tables["ranked"]),
        "canary_found": lambda tables: canary_found(tables, stored_index(tables, "postings")),
        "chunk_terms": lambda tables: tables["chunk"].select("chunk_id", terms("line").alias("terms")),
        "query_term": lambda tables: tables["search_request"].select("request_id", F.explode(F.array_distinct(terms("text"))).alias("term")),
        "indexed_chunk": lambda tables: stored_index(tables, "chunks").directory(),
        "posting": _postings,
        "keyword_match": lambda tables: keyword_match(tables, stored_index(tables, "chunks", "postings")),
        "keyword_score": _keyword_score,
        "vector_top": lambda tables: vector_top(tables, stored_index(tables, "chunks", "vectors")),
    }
)
