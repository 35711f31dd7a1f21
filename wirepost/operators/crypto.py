"""Cipher suites, key exchange, forward secrecy and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev


# ------------------------------------------------------------------------------ dimensions
def enrich_suite(spark: SparkSession, df: DataFrame, code: str = "suite_code") -> DataFrame:
    """Suite facts beside the code; a code outside the table keeps nulls."""
    dim = F.broadcast(vocab.dim_suite(spark).withColumnRenamed("code", code))
    return df.join(dim, code, "left")


def named_group(spark: SparkSession, df: DataFrame, code: str = "group_code") -> DataFrame:
    dim = F.broadcast(vocab.dim_group(spark).withColumnRenamed("group_code", code))
    return df.join(dim, code, "left")


def _hello_frames() -> tuple:
    f = "tls_negotiated_version"
    return F.col(f"{f}.frame_lo"), F.col(f"{f}.frame_hi"), F.col(f"{f}.frame_n")


def suite_name() -> Column:
    code, name, fr = F.col("suite_code"), F.col("suite_name"), _hello_frames()
    return (F.when(code.isNull(), ev.unknown("no cipher suite in a ServerHello"))
            .when(name.isNull(), ev.ambiguous(None, "cipher suite is not in the table", fr))
            .otherwise(ev.observed(name, "registry name of the suite", fr)))


def group_evidence() -> Column:
    code, name, fr = F.col("group_code"), F.col("group_name"), _hello_frames()
    return (F.when(code.isNull(), ev.unknown("no key share group in the ServerHello"))
            .when(name.isNull(), ev.ambiguous(None, "group is not in the registry", fr))
            .otherwise(ev.observed(name, "group of the ServerHello key share", fr)))


def _is_13() -> Column:
    return F.coalesce(ev.value_or("tls_negotiated_version") == "TLS1.3", F.lit(False))


def key_exchange() -> Column:
    """TLS 1.3 reads the negotiated group, earlier versions the suite name."""
    fr = _hello_frames()
    group, kex = F.col("group_name"), F.col("kex")
    return (F.when(_is_13() & group.isNotNull(),
                   ev.observed(F.concat(F.lit("ECDHE ("), group, F.lit(")")),
                               "negotiated in the key share extension", fr))
            .when(_is_13(), ev.inferred("ephemeral (EC)DHE", "only ephemeral exchange is allowed",
                                        fr))
            .when(F.col("suite_code").isNull(), ev.unknown("no cipher suite in a ServerHello"))
            .when(kex.isNull(), ev.ambiguous(None, "the suite does not name a key exchange", fr))
            .otherwise(ev.observed(kex, "key exchange named by the suite", fr)))


def forward_secrecy() -> Column:
    """Missing evidence is unknown, never absent forward secrecy."""
    fr, ephemeral = _hello_frames(), F.col("ephemeral")
    return (F.when(_is_13(), ev.inferred("true", "every TLS 1.3 suite is forward secret", fr))
            .when(F.col("suite_code").isNull(), ev.unknown("no cipher suite was observed"))
            .when(ephemeral.isNull(), ev.ambiguous(None, "the suite does not decide it", fr))
            .otherwise(ev.observed(ephemeral.cast("string"), "read from the suite", fr)))


def chain_evidence() -> Column:
    n = F.coalesce(F.size("certificates"), F.lit(0))
    return F.when(n > 0, ev.observed(n, "certificates seen in cleartext", _hello_frames())) \
        .otherwise(ev.not_observable("no cleartext certificate message in this stream"))


def enrich_sessions(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """Add the five derived crypto fields to sessions carrying `suite_code`, `group_code`."""
    if "certificates" not in sessions.columns:
        sessions = sessions.withColumns({
            "certificates": F.lit(None).cast(f"array<{CERT_TYPE}>"),
            "chain_links": F.lit(None).cast("array<boolean>"),
            "chain_signature_oids": F.lit(None).cast("array<string>")})
    joined = named_group(spark, enrich_suite(spark, sessions))
    return joined.withColumns({
        "tls_cipher_suite_name": suite_name(), "tls_key_exchange": key_exchange(),
        "tls_named_group": group_evidence(), "tls_forward_secrecy": forward_secrecy(),
        "tls_certificate_chain": chain_evidence(),
    }).drop("suite_hex", "suite_name", "kex", "auth", "enc", "mac", "is_tls13", "ephemeral",
            "group_name")


# ---------------------------------------------------------------------------- certificates
CERT_TYPE = ("struct<idx:int,key_algorithm:string,key_bits:int,not_before:bigint,"
             "not_after:bigint,ski:string,aki:string,self_signed:boolean>")


def once(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once, however often it is named; inside a lambda Spark
    works an expression out again wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rsa_bits(col: Column) -> Column:
    """Bit length of a colon-separated hexadecimal modulus, sign padding dropped."""
    def of_digits(significant):
        top = F.length(F.bin(F.conv(F.substring(significant, 1, 1), 16, 10).cast("bigint")))
        return F.when(significant != "", ((F.length(significant) - 1) * 4 + top).cast("int"))

    def of_octets(octets):
        well_formed = (F.size(octets) > 0) & F.forall(octets, lambda o: o.rlike("^[0-9a-fA-F]{1,2}$"))
        digits = F.array_join(F.transform(octets, lambda o: F.lpad(o, 2, "0")), "")
        return once(F.when(well_formed, F.regexp_replace(digits, "^0+", "")), of_digits)
    return once(F.filter(F.split(col, ":"), lambda o: o != ""), of_octets)


def cert_epoch(col: Column) -> Column:
    """UTC epoch of a certificate date, null when it is not one."""
    pattern = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"

    def of_text(text):
        # a text of this form has its numbers at fixed places
        year, month, day, hour, minute, second = (
            F.substring(text, at, 4 if at == 1 else 2).try_cast("int") for at in (1, 6, 9, 12, 15, 18))
        in_range = month.between(1, 12) & day.between(1, 31)
        first = F.make_date(year, F.when(in_range, month), F.lit(1))
        days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
        return F.when(in_range, days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second)
    return once(F.trim(col), lambda text: once(F.when(text.rlike(pattern), text), of_text))


def self_signed(ski: Column, aki: Column) -> Column:
    """Key identifiers equal; null when either is absent or empty."""
    return F.when((F.coalesce(ski, F.lit("")) != "") & (F.coalesce(aki, F.lit("")) != ""),
                  ski == aki)


def build_chain(df: DataFrame, x509: str = "x509") -> DataFrame:
    """Assemble a chain from the flat lists of one certificate message.

    A list belongs to single certificates only when its length says so: one entry each, or two
    for the validity dates.  Alternative names are attributed to a lone certificate only, and
    distinguished-name text never is.  Every certificate and every text is kept whole;
    `chain_truncated` only tells a display that the chain is longer than it may want to show.
    """
    # every list, and all that is read from its texts, is a column: worked out once for a message, not per certificate
    out = df.withColumns({f"_{name}": F.coalesce(F.col(x509)[name], F.array().cast("array<string>")) for name in vocab.X509_FIELD_NAMES})
    lists = {name: F.col(f"_{name}") for name in vocab.X509_FIELD_NAMES}
    n_all = F.when(F.size(lists["serials"]) > 0, F.size(lists["serials"])) \
        .otherwise(F.size(lists["cert_elements"]))
    out = out.withColumn("_n", n_all).withColumn("chain_truncated", F.col("_n") > vocab.MAX_CHAIN)
    n = F.col("_n")
    single = ("serials", "versions", "rsa_moduli", "subject_key_ids", "authority_key_ids")
    out = out.withColumns({f"_own_{name}": F.when(F.size(lists[name]) == n, lists[name]) for name in single}
                          | {"_own_dates": F.when(F.size(lists["validity_utc"]) == n * 2, lists["validity_utc"])})
    out = out.withColumns({"_own_epochs": F.transform("_own_dates", cert_epoch), "_own_bits": F.transform("_own_rsa_moduli", rsa_bits)})

    def take(name: str, i: Column) -> Column:
        return F.get(F.col(f"_own_{name}"), i)

    def certificate(i: Column) -> Column:
        ski, aki = take("subject_key_ids", i), take("authority_key_ids", i)
        return F.struct(
            i.cast("int").alias("idx"), take("serials", i).alias("serial"),
            take("versions", i).alias("version"),
            take("epochs", i * 2).alias("not_before"), take("epochs", i * 2 + 1).alias("not_after"),
            take("dates", i * 2).alias("not_before_text"), take("dates", i * 2 + 1).alias("not_after_text"),
            F.when(F.coalesce(take("rsa_moduli", i), F.lit("")) != "", "RSA").alias("key_algorithm"),
            take("bits", i).alias("key_bits"), ski.alias("ski"), aki.alias("aki"),
            self_signed(ski, aki).alias("self_signed"),
            F.when(n == 1, F.filter(lists["san_dns"], lambda s: s != "")).alias("san"))

    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("certificates", F.transform(index, certificate))
    return out.withColumns({
        "unattributed": F.array_compact(F.array(
            F.when((n > 0) & (F.size(lists["dn_text"]) > 0), "distinguished names"),
            F.when((n > 0) & (F.size(lists["algorithm_ids"]) > 0)
                   & (F.size(lists["algorithm_ids"]) != n), "signature algorithms"),
            F.when((n > 1) & (F.size(lists["san_dns"]) > 0), "subjectAltName entries"))),
        "chain_signature_oids": lists["algorithm_ids"],
        "chain_links": links(F.col("certificates")),
    }).drop("_n", *[f"_{name}" for name in vocab.X509_FIELD_NAMES], *[f"_own_{name}" for name in (*single, "dates", "epochs", "bits")])


def links(certs: Column) -> Column:
    """For each neighbouring pair, whether the first names the key of the second."""
    def linked(pair):
        aki, ski = F.coalesce(pair["aki"], F.lit("")), F.coalesce(pair["ski"], F.lit(""))
        return (aki != "") & (aki == ski)
    n = F.size(certs)
    pairs = F.zip_with(
        F.slice(certs, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(certs, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["aki"].alias("aki"), b["ski"].alias("ski")))
    return F.transform(pairs, linked)


def chain_arrays(certs: DataFrame, keys: list[str]) -> DataFrame:
    """Certificate rows to one chain per key; a handshake message bounds its length."""
    row = F.struct("idx", F.when(F.col("key_bits").isNotNull(), "RSA").alias("key_algorithm"),
                   "key_bits", "not_before", "not_after", "ski", "aki",
                   self_signed(F.col("ski"), F.col("aki")).alias("self_signed"))
    signed = F.struct("idx", F.col("sig_oid").alias("oid"))
    grouped = certs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("certificates"),
        F.sort_array(F.collect_list(signed)).alias("_oids"))
    return grouped.select(
        *keys, "certificates", links(F.col("certificates")).alias("chain_links"),
        F.transform("_oids", lambda o: o["oid"]).alias("chain_signature_oids"))


def chain_links(certs: DataFrame, keys: list[str]) -> DataFrame:
    """The link of each certificate row to the next one of its chain."""
    chained = chain_arrays(certs, keys)
    return chained.select(*keys, F.posexplode("chain_links").alias("idx", "linked"))


def signature_hashes(spark: SparkSession, certs: DataFrame, keys: list[str]) -> DataFrame:
    """Known signature names of a chain and the first deprecated hash in chain order."""
    dim = F.broadcast(vocab.dim_signature(spark).withColumnRenamed("oid", "sig_oid"))
    return (certs.join(dim, "sig_oid", "left").groupBy(*keys)
            .agg(F.count("sig_name").alias("recognised"),
                 F.min_by("sig_hash", F.when(F.col("deprecated"), F.col("idx")))
                 .alias("deprecated_hash")))


def describe_oid(spark: SparkSession, df: DataFrame, oid: str) -> DataFrame:
    """Best display name; an OID no table lists stands for itself."""
    dim = F.broadcast(vocab.dim_oid(spark).withColumnRenamed("oid", oid))
    return df.join(dim, oid, "left") \
        .withColumn("oid_name", F.coalesce("oid_name", F.when(F.col(oid) != "", F.col(oid))))


def parse_code(text: Column) -> Column:
    """Suite or group code from decimal or 0x text."""
    return casts.to_int(text).cast("int")
