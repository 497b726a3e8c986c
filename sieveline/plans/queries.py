"""Queries of the screening engine over the driver's tables.

The tables hold no list, so page titles stand in for listed names (uid = page_id; English pages as individuals, others as
entities), titles without their last word for customers that should be found, and supplier names for customers that should
not. All rows of each table take part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys, similarity, text
from ..functions.reference_data import TRAILING
from ..operators import adjudication, benchmark, evaluation, names_index, screening
from ..shipping import ship_package
from ..sources import records, watchlist


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, entry_type, primary_name)."""
    pages = _read(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="(.*?)"', 1)
    return pages.select(
        F.col("page_id").alias("uid"), F.when(lang == "en", "individual").otherwise("entity").alias("entry_type"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("primary_name"),
    )


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select(
        F.col("uid").alias("name_id"), "uid", "entry_type", F.lit("primary").alias("name_kind"), F.lit(False).alias("is_weak"), F.col("primary_name").alias("display")
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share; without one only a local master goes on, with the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread_out(df: DataFrame) -> DataFrame:
    """Over all cores, where a small table has fewer files: what follows is much work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index; it is kept for the session, as a stored one would be, and later queries find it by its plan."""
    return names_index.derive(spread_out(raw_names(spark, sf_dir))).persist()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, subject_type, query_name, is_true_match, source_uid, perturbation_type)."""
    shorter = titles(spark, sf_dir).select(
        F.concat(F.lit("P-"), F.col("uid").cast("string")).alias("query_id"), F.col("entry_type").alias("subject_type"),
        F.regexp_replace("primary_name", " [^ ]+$", "").alias("query_name"), F.lit(True).alias("is_true_match"), F.col("uid").alias("source_uid"),
        F.lit("token_drop").alias("perturbation_type"),
    )
    strangers = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N-"), F.col("s_suppkey").cast("string")).alias("query_id"), F.lit("entity").alias("subject_type"), F.col("s_name").alias("query_name"),
        F.lit(False).alias("is_true_match"), F.lit(None).cast("long").alias("source_uid"), F.lit(None).cast("string").alias("perturbation_type"),
    )
    return shorter.unionByName(strangers)


def _near(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Each customer's nearest titles, ``limit`` at most."""
    q, members = screening.once(spread_out(customers(spark, sf_dir)))
    near = screening.for_all(screening.trigram_pairs(q, names(spark, sf_dir), limit=limit, once=True), members)
    return screening.best_rows(near, limit, F.desc("sim"), "name_id")


def normalize_names(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("norm"))


def company_names(spark, sf_dir):
    forms = F.array(*map(F.lit, TRAILING))
    second = F.get(forms, F.pmod("p_partkey", F.lit(len(TRAILING))).cast("int"))
    return spread_out(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.concat_ws(" ", "p_name", F.get(forms, (F.col("p_size") % len(TRAILING)).cast("int")), second).alias("company"))


def legal_forms(spark, sf_dir):
    norm = text.normalize(F.col("company"))
    return company_names(spark, sf_dir).select(
        "p_partkey", text.find_legal_suffix(norm).alias("suffix"), text.jurisdiction(norm).alias("jurisdiction"), F.trim(text.strip_legal_suffix(norm)).alias("without_one"), text.strip_legal_forms(norm).alias("stem")
    )


def name_acronyms(spark, sf_dir):
    return names(spark, sf_dir).select("name_id", "name_norm", F.array_join("acronyms", ",").alias("acronyms"))


def acronym_group_sizes(spark, sf_dir):
    return names_index.acronym_groups(names(spark, sf_dir)).select("acronym", "n_rows", "n_uids")


def trigram_topk(spark, sf_dir):
    return _near(spark, sf_dir, 50).select("query_id", "name_id", F.round("sim", 6).alias("sim"))


def phonetic_overlap(spark, sf_dir):
    q, members = screening.once(spread_out(customers(spark, sf_dir)))
    pairs = screening.for_all(screening.phonetic_pairs(q, names(spark, sf_dir), limit=50, once=True), members)
    return screening.best_rows(pairs, 50, F.desc("sim"), "name_id").select("query_id", "name_id", F.round("sim", 6).alias("sim"))


def acronym_lookup(spark, sf_dir):
    """Customers named by the initials of listed names."""
    listed = names(spark, sf_dir)
    asked = listed.where("size(acronyms) > 0").select(F.concat(F.lit("A-"), F.col("uid").cast("string")).alias("query_id"), F.lit("entity").alias("subject_type"), F.get("acronyms", F.lit(0)).alias("query_name"))
    pairs = screening.acronym_pairs(screening.prepare(asked), listed)
    return screening.best_rows(pairs, 100, "uid", "name_id").select("query_id", "name_id")


def token_similarity(spark, sf_dir):
    """Token similarity of all distinct title words that share their first two letters.

    Words are few bytes and their pairs many: the first words of a beginning are dealt over tasks by their number, not by their size.
    """
    words = names(spark, sf_dir).select(F.explode(F.split("name_norm", " ")).alias("w")).distinct().withColumn("k", F.left("w", F.lit(2))).persist()
    parts = words.groupBy("k").agg(F.ceil(F.count("*") / 256).cast("int").alias("n"))
    tasks = 8 * spark.sparkContext.defaultParallelism
    first = words.join(parts, "k").select("k", F.pmod(F.xxhash64("w"), F.col("n")).cast("int").alias("p"), F.col("w").alias("a"))
    second = words.join(parts, "k").select("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"), F.col("w").alias("b"))
    pairs = first.repartition(tasks, "k", "p").join(second.repartition(tasks, "k", "p"), ["k", "p"]).where("a <= b")
    return pairs.select("a", "b", F.round(similarity.token_sim("a", "b"), 6).alias("sim"))


def idf(spark, sf_dir):
    return names_index.stem_idf(names(spark, sf_dir)).select("token", "df", F.round("idf", 6).alias("idf"))


def name_scores(spark, sf_dir):
    """Scores of all names that trigrams propose."""
    listed = names(spark, sf_dir)
    q, members = screening.once(spread_out(customers(spark, sf_dir)))
    proposed = screening.trigram_pairs(q, listed, once=True).select("query_id", "uid").distinct().withColumn("generators", F.array(F.lit("trigram")))
    scored = screening.score(q, listed, proposed).select("query_id", "name_id", F.round("score", 6).alias("score"))
    return screening.for_all(scored, members)


def screen(spark, sf_dir):
    out = screening.screen(customers(spark, sf_dir), names(spark, sf_dir))
    return out.select("query_id", "position", "uid", F.round(F.round("score", 9), 4).alias("score"), "entry_type", "matched_name", "name_kind", "is_weak", F.array_join("generators", ",").alias("generators"), "ambiguous")


def screened_records(spark, sf_dir):
    """The shortlist as records, one a customer, also where nothing is found."""
    q = customers(spark, sf_dir)
    out = screening.nested(q, screening.screen(q, names(spark, sf_dir)))
    return out.select("query_id", F.to_json("candidates").alias("candidates"))


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers, and their ten nearest titles as candidates."""
    q = customers(spark, sf_dir)
    near = _near(spark, sf_dir, 10)
    position = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "name_id"))
    shown = names(spark, sf_dir).select("name_id", F.col("display").alias("matched_name"))
    return q, near.select("query_id", position.alias("position"), "uid", F.col("sim").alias("score"), F.lit(False).alias("ambiguous"), "name_id").join(shown, "name_id").persist()


def recall_at_k(spark, sf_dir):
    return evaluation.recall(evaluation.ranks(*_judged(spark, sf_dir)))


def recall_by_perturbation(spark, sf_dir):
    return evaluation.recall_by_perturbation(evaluation.ranks(*_judged(spark, sf_dir)))


def operating_points(spark, sf_dir):
    return evaluation.operating_points(*_judged(spark, sf_dir))


def threshold_baseline(spark, sf_dir):
    return evaluation.threshold_baseline(*_judged(spark, sf_dir))


def misses(spark, sf_dir):
    q, c = _judged(spark, sf_dir)
    return evaluation.misses(evaluation.ranks(q, c), c, titles(spark, sf_dir))


def _list_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as entries, their orders as facts, their nations as addresses."""
    c = _read(spark, sf_dir, "customer")
    entries = c.select(F.col("c_custkey").alias("uid"), F.when(F.col("c_mktsegment") == "MACHINERY", "entity").otherwise("individual").alias("entry_type"), F.col("c_name").alias("primary_name"), F.lit(None).cast("string").alias("first_name"), F.col("c_name").alias("last_name"))
    o = _read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "dob").when(F.col("o_orderpriority") == "2-HIGH", "place_of_birth").otherwise("registration_number")
    value = F.when(kind == "dob", F.concat(F.lit("circa "), F.year("o_orderdate").cast("string"))).when(kind == "place_of_birth", F.concat(F.lit("Town, "), F.col("o_orderstatus"))).otherwise(F.col("o_orderkey").cast("string"))
    features = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), kind.alias("feature_type"), value.alias("value_text"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("value_country"))
    n = _read(spark, sf_dir, "nation")
    addresses = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("uid"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("city"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("country")
    )
    return entries, features, addresses


def _publication(spark, sf_dir) -> DataFrame:
    """Customers written as a list publication and read back: aliases, birth dates and papers are their orders."""
    o = _read(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "dd MMM yyyy"))
    kind = F.col("o_orderpriority")
    gathered = lambda when, item: F.sort_array(F.collect_list(F.when(when, F.struct("o_orderkey", item.alias("x")))))
    text = lambda c: F.col(c).cast("string")
    facts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        gathered(kind == "5-LOW", F.struct(F.when(F.col("o_orderstatus") == "P", "Weak").otherwise("strong").alias("category"), F.concat(F.lit(" ORDER "), text("o_orderkey")).alias("lastName"), F.when(F.col("o_orderstatus") == "F", "Old").alias("firstName"))).alias("akas"),
        gathered(kind == "1-URGENT", F.struct(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("circa "), text("day"))).otherwise(F.col("day")).alias("dateOfBirth"))).alias("births"),
        gathered(kind == "3-MEDIUM", F.struct(F.lit("Passport No.").alias("idType"), text("o_orderkey").alias("idNumber"), F.col("day").alias("issueDate"), F.col("o_orderstatus").alias("idCountry"))).alias("papers"),
    )
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    items = lambda name: F.transform(name, lambda x: x["x"])
    firm = F.col("c_mktsegment") == "MACHINERY"
    address = F.struct(F.when(F.col("c_acctbal") > 0, F.concat(F.lit("No. "), text("c_custkey"))).alias("address1"), F.lit("Floor 1").alias("address3"), F.col("c_mktsegment").alias("city"), F.col("n_name").alias("country"))
    entries = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(facts, "c_custkey", "left").select(
        text("c_custkey").alias("uid"), F.when(firm, "Entity").otherwise("Individual").alias("sdnType"), F.when(~firm & (F.col("c_acctbal") > 0), "Given").alias("firstName"), F.col("c_name").alias("lastName"),
        F.struct(F.array("c_mktsegment", "n_name").alias("program")).alias("programList"), F.struct(items("akas").alias("aka")).alias("akaList"),
        F.struct(items("births").alias("dateOfBirthItem")).alias("dateOfBirthList"), F.struct(items("papers").alias("id")).alias("idList"), F.struct(F.array(address).alias("address")).alias("addressList"),
        F.struct(F.when(~firm & (F.col("c_acctbal") > 0), F.array(F.struct(F.concat_ws(", ", "c_mktsegment", "n_name").alias("placeOfBirth")))).alias("placeOfBirthItem")).alias("placeOfBirthList"),
        F.struct(F.when(~firm, F.array(F.struct(F.col("n_name").alias("country")))).alias("nationality")).alias("nationalityList"),
        F.struct(F.when(~firm & (F.col("c_acctbal") < 0), F.array(F.struct(F.col("n_name").alias("country")))).alias("citizenship")).alias("citizenshipList"),
        F.when(firm, F.struct(
            F.concat(F.lit("CS"), text("c_custkey")).alias("callSign"), F.lit(" Tanker ").alias("vesselType"), F.col("n_name").alias("vesselFlag"),
            F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("vesselOwner"), text("c_nationkey").alias("tonnage"), F.lit(" ").alias("grossRegisteredTonnage"),
        )).alias("vesselInfo"),
    )
    path = shared_path(spark, "list")
    entries.write.format("xml").option("rootTag", "sdnList").option("rowTag", "sdnEntry").save(path)
    return watchlist.read_entries(spark, path)


def list_entries(spark, sf_dir):
    out = watchlist.entries(_publication(spark, sf_dir))
    return out.select("uid", "entry_type", "primary_name", "first_name", "last_name", F.array_join("programs", ",").alias("programs"))


def list_aliases(spark, sf_dir):
    return watchlist.aliases(_publication(spark, sf_dir)).select("id", "uid", "alias_name", "is_weak")


def list_features(spark, sf_dir):
    out = watchlist.features(_publication(spark, sf_dir))
    return out.select("uid", "feature_type", "value_text", F.date_format("value_date", "yyyy-MM-dd").alias("value_date"), "value_country")


def list_addresses(spark, sf_dir):
    return watchlist.addresses(_publication(spark, sf_dir)).select("uid", "address", "city", "country")


def built_index(spark, sf_dir):
    """The name index of the publication: primaries, then aliases."""
    raw = _publication(spark, sf_dir)
    out = names_index.build(watchlist.entries(raw), watchlist.aliases(raw))
    return out.select("uid", "entry_type", "name_kind", "is_weak", "display", "name_norm", "stem")


def md5_sample(spark, sf_dir):
    e, f, a = _list_tables(spark, sf_dir)
    return benchmark.sample(e, f, a, "individual", 100, ("dob",)).select("uid", "primary_name", "city", "country")


def customer_attributes(spark, sf_dir):
    e, f, a = _list_tables(spark, sf_dir)
    return benchmark.attributes(e, f, a).select("uid", "query_attributes.*", "n_birth_years")


def first_place(spark, sf_dir):
    """City and country of the first order line's supplier, each the first that is there."""
    li, s, n = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("l_orderkey").alias("uid"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_suppkey")).alias("id"),
        F.when(F.col("l_returnflag") != "N", F.col("s_name")).alias("city"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("country"),
    )
    return benchmark.first_place(rows)


def feature_histogram(spark, sf_dir):
    e, f, _ = _list_tables(spark, sf_dir)
    return f.join(e, "uid").groupBy("entry_type", "feature_type").agg(F.count("*").alias("n"))


def birth_years(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    shown = F.concat(F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" or "), F.year("o_orderdate") + 1)
    rows = o.select(F.col("o_custkey").alias("uid"), F.explode(text.years(shown)).alias("y"))
    return rows.groupBy("uid").agg(F.countDistinct("y").alias("n_years"), F.min("y").alias("first_year"))


def listed_dates(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("circa "), F.year("o_orderdate").cast("string"))).otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    return o.select("o_orderkey", F.date_format(text.listed_date(raw), "yyyy-MM-dd").alias("value_date"))


def stratified_split(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("stratum"))
    md5 = F.md5(F.col("doc_id").cast("string").cast("binary"))
    dev = benchmark.pick_dev(rows, "stratum", "doc_id", 0.25, md5).withColumn("dev", F.lit(True))
    return rows.distinct().join(dev, ["stratum", "doc_id"], "left").select("doc_id", "stratum", F.when(F.col("dev"), "dev").otherwise("test").alias("split"))


def frozen_split(spark, sf_dir):
    return adjudication.frozen_split(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def _firms(spark, sf_dir) -> DataFrame:
    company = company_names(spark, sf_dir).withColumn("company", F.concat_ws(" ", F.when(F.col("p_partkey") % 3 == 0, F.lit("The")), F.regexp_replace("company", " ", F.when(F.col("p_partkey") % 5 == 0, " & ").otherwise("-"))))
    return company.select(F.col("p_partkey").alias("uid"), F.lit("entity").alias("entry_type"), F.col("company").alias("primary_name"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.lit("dubai").alias("city"))


def perturb_companies(spark, sf_dir):
    return benchmark.plain_perturbations(_firms(spark, sf_dir)).select("uid", "perturbation_type", "query_name")


def perturb_drawn(spark, sf_dir):
    return benchmark.drawn_perturbations(_firms(spark, sf_dir))


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, f, a = _list_tables(spark, sf_dir)
    sampled = benchmark.sample(e, f, a, "entity", 200, ("registration_number",)).unionByName(benchmark.sample(e, f, a, "individual", 200, ("dob",)))
    pos = benchmark.positives(sampled, benchmark.attributes(e, f, a))
    queries = pos.unionByName(benchmark.negatives(e, f, a, 400), allowMissingColumns=True)
    return queries, e, f, a


def benchmark_queries(spark, sf_dir):
    queries = benchmark.assign_splits(_labelled(spark, sf_dir)[0])
    return queries.withColumn("query_attributes", F.to_json("query_attributes"))


def benchmark_conformance(spark, sf_dir):
    queries, e, _, _ = _labelled(spark, sf_dir)
    aliases = e.select("uid", F.lower("primary_name").alias("alias_name"))
    return benchmark.conformance(queries, e, aliases)


def benchmark_split_report(spark, sf_dir):
    return benchmark.split_report(benchmark.assign_splits(_labelled(spark, sf_dir)[0]))


def adjudicated(spark, sf_dir):
    """Entities screened by equal country, prechecked, judged by a stand-in, decided."""
    e, f, a = _list_tables(spark, sf_dir)
    asked = benchmark.attributes(e, f, a).join(e.select("uid", "entry_type"), "uid").select(F.concat(F.lit("Q-"), F.col("uid").cast("string")).alias("query_id"), F.col("entry_type").alias("subject_type"), "query_attributes.*", "uid")
    pairs = asked.join(adjudication.profiles(e, f, a), "uid").withColumns({"score": F.lit(1.0), "cities": F.array("city"), "ambiguous": F.lit(False)})
    decided = adjudication.decide(adjudication.similarity_verdicts(adjudication.precheck(pairs)))
    return adjudication.disposition(decided).select("query_id", "outcome", F.array_join(F.col("uids").cast("array<string>"), ",").alias("uids"))


def outcome_intervals(spark, sf_dir):
    """Toxic labels as failures: share, Wilson interval and zero-failure bound by quality."""
    g = _read(spark, sf_dir, "labels").groupBy("quality").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    w = adjudication.wilson(F.col("k"), F.col("n"))
    return g.select("quality", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.round(adjudication.zero_failure_bound(F.col("n")), 6).alias("bound"))


def bootstrap(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("hit"))
    r = adjudication.cluster_bootstrap(o, "o_custkey", "hit", 200)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def mcnemar(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderpriority") == "2-HIGH").alias("b"))
    return adjudication.mcnemar(o, "a", "b").select("only_a", "only_b", F.round("p_value", 6).alias("p_value"))


def flip_rate(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.lit(0).alias("uid"), F.col("l_returnflag").alias("outcome"))
    return adjudication.flip_rate(li)


def confusion(spark, sf_dir):
    names_of = F.create_map(*[x for k, v in (("R", "true_match"), ("A", "possible_match"), ("N", "false_positive"), ("O", "possible_match"), ("F", "true_match")) for x in (F.lit(k), F.lit(v))])
    li = _read(spark, sf_dir, "lineitem").select(names_of[F.col("l_returnflag")].alias("outcome"), names_of[F.col("l_linestatus")].alias("expected_outcome"))
    return adjudication.confusion(li)


def stored_index(spark, sf_dir):
    """The index stored from entities, individuals appended, everything appended once more, and read back."""
    listed, path = names(spark, sf_dir), shared_path(spark, "index")
    names_index.write(listed.where("entry_type = 'entity'"), path)
    names_index.add(listed.where("entry_type = 'individual'"), path)
    names_index.add(listed, path)
    out = names_index.read(spark, path)
    return out.select("name_id", "entry_type", "name_norm", "stem", F.array_join("acronyms", ",").alias("acronyms"), F.size("grams").alias("n_grams"))


def index_differences(spark, sf_dir):
    """What a check of a stored index against a fresh one finds: here every seventh row has another mark, every eleventh is missing."""
    fresh = raw_names(spark, sf_dir).select("name_id", "display", "is_weak")
    stored = fresh.where("name_id % 11 <> 0").withColumn("is_weak", F.col("name_id") % 7 == 0)
    return names_index.differences(fresh, stored)


def phonetic_codes(spark, sf_dir):
    return names(spark, sf_dir).select("name_id", F.array_join("phonetic_keys", ",").alias("phonetic_keys"))


def acronym_expansion(spark, sf_dir):
    """Customers whose name spells out a listed one."""
    listed = names(spark, sf_dir)
    short = listed.where("size(acronyms) > 0").select("name_id", "uid", "entry_type", "name_kind", "is_weak", F.get("acronyms", F.lit(0)).alias("display"))
    asked = titles(spark, sf_dir).where("entry_type = 'entity'").select(F.concat(F.lit("S-"), F.col("uid").cast("string")).alias("query_id"), F.lit("entity").alias("subject_type"), F.col("primary_name").alias("query_name"))
    pairs = screening.acronym_pairs(screening.prepare(asked), names_index.derive(short))
    return screening.best_rows(pairs, 100, "uid", "name_id").select("query_id", "name_id")


def idf_one_form(spark, sf_dir):
    """Document frequencies over names without one trailing legal form."""
    stems = company_names(spark, sf_dir).select(F.trim(text.strip_legal_suffix(text.normalize(F.col("company")))).alias("stem"))
    return similarity.idf_table(stems).select("token", "df", F.round("idf", 6).alias("idf"))


def distinctive_words(spark, sf_dir):
    norm = text.normalize(F.concat_ws(" ", F.col("company"), F.when(F.col("p_partkey") % 2 == 0, "International Trading"), F.when(F.col("p_partkey") % 3 == 0, "LLC")))
    return company_names(spark, sf_dir).select("p_partkey", F.array_join(text.distinctive_tokens(norm), ",").alias("words"))


def perturb_people(spark, sf_dir):
    """Titles as persons: their last word is the family name."""
    words = F.split("primary_name", " ")
    people = titles(spark, sf_dir).where(F.size(words) >= 2).select(
        "uid", F.lit("individual").alias("entry_type"), "primary_name", F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("first_name"),
        F.concat(F.lit("al-"), F.element_at(words, -1)).alias("last_name"), F.lit(None).cast("string").alias("city"),
    )
    return benchmark.plain_perturbations(people).select("uid", "perturbation_type", "query_name")


def unanswered_queries(spark, sf_dir):
    answered = _near(spark, sf_dir, 1).select("query_id").distinct()
    return evaluation.unanswered(customers(spark, sf_dir), answered)


def list_violations(spark, sf_dir):
    """Customers as entries, each twentieth of them twice and each seventh of an unknown type; orders as rows of unknown entries."""
    e, f, a = _list_tables(spark, sf_dir)
    e = e.unionByName(e.where("uid % 20 = 0")).withColumn("entry_type", F.when(F.col("uid") % 7 == 0, "ship").otherwise(F.col("entry_type")))
    far = f.withColumn("uid", F.col("uid") * 2)
    t = {"entries": e.withColumn("primary_name", F.when(F.col("uid") % 9 > 0, F.col("primary_name"))), "aliases": far, "features": f, "addresses": a.withColumn("uid", -F.col("uid"))}
    return watchlist.violations(t)


def split_faults(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").select(
        F.lit(True).alias("is_true_match"), (F.col("doc_id") % 97).alias("source_uid"), F.when(F.col("quality") == 1, "dev").when(F.col("toxic") == 0, "test").alias("split")
    )
    return benchmark.split_faults(rows)


def _line_pairs(spark, sf_dir) -> DataFrame:
    """Order lines as (query_id, uid): a customer's order and a part."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("Q-"), F.col("l_orderkey").cast("string")).alias("query_id"), F.col("l_partkey").alias("uid"), "l_linenumber", "l_returnflag", "l_linestatus")


def answer_faults(spark, sf_dir):
    """Lines that are done were asked; answers come for returned or accepted ones, some twice, some with words that are not there."""
    li = _line_pairs(spark, sf_dir)
    asked = li.where("l_linestatus = 'F'").select("query_id", "uid").distinct().withColumn("names", F.array(F.col("uid").cast("string")))
    answers = li.where("l_returnflag <> 'N' or l_linenumber = 1").select("query_id", "uid", F.when(F.col("uid") % 10 > 0, F.col("uid").cast("string")).otherwise("?").alias("listed_evidence"))
    return adjudication.invalid_answers(asked, answers)


def judgement_chunks(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    position = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = o.select(F.col("o_custkey").alias("query_id"), "o_orderkey", position.alias("position"))
    return adjudication.chunks(pairs, 4).select("query_id", "o_orderkey", "chunk")


def screening_funnel(spark, sf_dir):
    li = _line_pairs(spark, sf_dir).withColumn("conflict", F.when(F.col("l_returnflag") == "A", "location"))
    decided = li.where("conflict is null").withColumn("outcome", F.when(F.col("l_linestatus") == "F", "false_positive").otherwise("possible_match"))
    return adjudication.funnel(li.select("query_id").distinct(), li, li, decided)


def nickname_variants(spark, sf_dir):
    """Parts by name, each first word a nickname of another."""
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_name"))
    short = F.split("query_name", " ")[0]
    nicknames = parts.select(short.alias("nickname"), F.concat(F.lit("Mc"), short).alias("name")).distinct()
    return adjudication.expand_nicknames(parts, nicknames)


def records_round_trip(spark, sf_dir):
    """Customers written as JSON lines and read back, those of one split."""
    path = shared_path(spark, "records")
    asked = customers(spark, sf_dir).withColumn("split", F.when(F.length("query_name") % 4 == 0, "dev").otherwise("test"))
    records.write_json(asked, path)
    return records.read_queries(spark, path, "dev").select("query_id", "subject_type", "query_name", "is_true_match", "source_uid", "split")


def feature_report(spark, sf_dir):
    """The histogram of facts as one JSON text."""
    return records.report_row(feature_histogram(spark, sf_dir), "features")


QUERIES = {
    f.__name__: f
    for f in (
        screen, screened_records, normalize_names, legal_forms, name_acronyms, acronym_group_sizes, trigram_topk, phonetic_overlap, acronym_lookup, token_similarity, idf,
        name_scores, recall_at_k, recall_by_perturbation, operating_points, threshold_baseline, misses, list_entries, list_aliases, list_features, list_addresses, built_index, md5_sample, customer_attributes, first_place, feature_histogram,
        birth_years, listed_dates, stratified_split, frozen_split, perturb_companies, perturb_drawn, benchmark_queries, benchmark_conformance, benchmark_split_report,
        adjudicated, outcome_intervals, bootstrap, mcnemar, flip_rate, confusion, stored_index, index_differences, phonetic_codes, acronym_expansion, idf_one_form, distinctive_words,
        perturb_people, unanswered_queries, list_violations, split_faults, answer_faults, judgement_chunks, screening_funnel, nickname_variants, records_round_trip, feature_report,
    )
}
