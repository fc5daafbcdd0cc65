"""Findings-shaped views of the driver's tables, and the same views as DuckDB SQL.

The tables hold no source code, so these views bind operators to them for checking their semantics: every column is a
fixed expression of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RULE_SCHEMA

LABELS = ["RSA-2048", "RSA", "ECDSA-P256", "AES-128", "AES-GCM", "3DES", "SHA-1", "SHA-256", "MD5", "HMAC", "HMAC-SHA1", "ECDSA-P-256", "TLS", "X25519-256", "", "quux", "DH"]
RULES = [
    ("PY_IMPORT_HASHLIB", "crypto-api", "library"),
    ("GO_USE_CRYPTO", "crypto-api", "library"),
    ("RB_OPENSSL_REQUIRE", "crypto-api", "library"),
    ("JAVA_RSA_CALL", "crypto-api", "key_generation"),
    ("CS_HARDCODED_KEY", "hardcoded-key", "key_storage"),
    ("PY_MD5_CALL", "weak-hash", "hashing"),
    ("SBOM_NPM_NODE_RSA", "crypto-dependency", "dependency"),
    ("NGINX_TLS_OLD", "weak-tls", "tls_config"),
    ("ANY_SHA_CONST", "crypto-fingerprint", "fingerprint"),
    ("GO_MODEXP", "handrolled-crypto", "fingerprint"),
    ("PY_FEISTEL", "handrolled-crypto", "fingerprint"),
]
SEVERITY_CYCLE = ["info", "low", "medium", "high", "critical", "odd"]
SAFETY_CYCLE = ["vulnerable", "grover_weakened", "classically_broken", "hybrid", "quantum_safe", "unknown"]
CHANNELS = {"A": "ast", "N": "sbom", "R": "tls"}

#: Rules for the documents: id, pattern, severity.
DOCUMENT_RULES = [
    ("DOC_TOKEN", r'\b(?:token|secret|key) = "[^"]*"', "critical"),
    ("DOC_EMAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "high"),
    ("DOC_IPV4", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "medium"),
    ("DOC_DIGITS", r"\b[0-9]{12,}\b", "low"),
    ("DOC_JUNK", r"[#%$&*]{3}", "info"),
    ("DOC_LICENSE", r"licensed under", "info"),
    ("DOC_EN", r"\bthe\b", "info"),
]

#: Syllables, of which each makes a rule of a large pack: words that begin or end with it.
SYLLABLES = [a + b + c for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou" for c in "lmnrstx"]


def many_rules(spark: SparkSession) -> DataFrame:
    """A pack of 700 rules, as most real ones are: case aside, and with alternatives at the top."""
    rows = []
    for n, s in enumerate(SYLLABLES):
        row = {"rule_ordinal": n, "rule_id": f"DOC_{s.upper()}", "language": "any", "severity": "info", "detector_type": "regex", "flags": "i" if n % 2 else "", "file_globs": []}
        row["pattern"] = ("" if n % 2 else "(?i)") + rf"\b{s}[a-z]{{2,}}\b|\b[a-z]{{3,}}{s}\b"
        rows.append(tuple(row.get(f.name) for f in RULE_SCHEMA))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings."""
    li = table(spark, sf_dir, "lineitem")
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    channel = F.lit(None)
    for flag, name in CHANNELS.items():
        channel = F.when(F.col("l_returnflag") == flag, F.lit(name)).otherwise(channel)
    return li.select(
        F.concat_ws("-", order, "l_linenumber").alias("finding_id"),
        channel.alias("channel"),
        pick(LABELS, part).alias("algorithm"),
        pick([r[0] for r in RULES], supp + order).alias("rule_id"),
        pick([r[1] for r in RULES], supp + order).alias("category"),
        pick([r[2] for r in RULES], supp + order).alias("usage_type"),
        pick(SEVERITY_CYCLE, F.col("l_quantity").cast("int")).alias("severity"),
        pick(SAFETY_CYCLE, order).alias("quantum_safety"),
        F.when(part % 3 == 0, 1024).when(part % 3 == 1, 2048).cast("int").alias("key_size"),
        F.concat(F.lit("src/m"), supp % 97, F.lit("/f"), part % 53, F.lit(".py")).alias("file_path"),
        F.concat(F.lit("m"), supp % 97).alias("module"),
        (F.col("l_linenumber") * 10 + part % 7).cast("int").alias("line_number"),
        F.col("l_quantity").cast("int").alias("column"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.concat(F.lit("call "), part % 211).alias("snippet"),
        F.lit("python").alias("language"),
        (order * 10 + F.col("l_linenumber")).alias("position"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list, index: str) -> str:
    return f"list_extract({_list(values)}, CAST({index} % {len(values)} + 1 AS INTEGER))"


FINDINGS_SQL = f"""
f AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS finding_id,
         CASE l_returnflag WHEN 'A' THEN 'ast' WHEN 'N' THEN 'sbom' WHEN 'R' THEN 'tls' END AS channel,
         {_pick(LABELS, "l_partkey")} AS algorithm,
         {_pick([r[0] for r in RULES], "(l_suppkey + l_orderkey)")} AS rule_id,
         {_pick([r[1] for r in RULES], "(l_suppkey + l_orderkey)")} AS category,
         {_pick([r[2] for r in RULES], "(l_suppkey + l_orderkey)")} AS usage_type,
         {_pick(SEVERITY_CYCLE, "CAST(l_quantity AS INTEGER)")} AS severity,
         {_pick(SAFETY_CYCLE, "l_orderkey")} AS quantum_safety,
         CAST(CASE l_partkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 END AS INTEGER) AS key_size,
         concat('src/m', l_suppkey % 97, '/f', l_partkey % 53, '.py') AS file_path,
         concat('m', l_suppkey % 97) AS module,
         CAST(l_linenumber * 10 + l_partkey % 7 AS INTEGER) AS line_number,
         CAST(l_quantity AS INTEGER) AS "column",
         l_discount * 10 AS confidence,
         concat('call ', l_partkey % 211) AS snippet,
         'python' AS language,
         l_orderkey * 10 + l_linenumber AS position
  FROM lineitem)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, language, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit(""), "source", F.lit("/"), F.col("doc_id") % 10, F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("text"))


def changing_documents(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Documents as files (path, language, text, content, version): before (1) and after (2) some have changed."""
    own, k = documents(spark, sf_dir), F.regexp_extract("path", r"doc_(\d+)", 1).cast("long") % 100
    text = F.when(k == 7, F.concat("text", F.lit("\nlicensed under A"))).otherwise(F.col("text")) if step == 2 else F.col("text")
    version = F.when(k.isin(7, 9), step).otherwise(1)
    return own.where(k != (8 if step == 2 else 11)).select("path", "language", text.alias("text"), text.cast("binary").alias("content"), version.alias("version"))


def ordered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of files, of which there is a version a year: a line comes with its order's year, and some are away
    from three to four years after and come back."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 60).alias("f"), F.year("o_orderdate").alias("y"))
    each = orders.withColumn("version", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    age = F.col("version") - F.col("y")
    there = each.where((age >= 0) & ((F.col("k") % 3 != 0) | ~age.between(3, 4)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(F.lit("order "), k.cast("string"))), "\n")
    files = there.groupBy("f", "version").agg(text.alias("text"))
    return files.select(F.concat(F.lit("f"), "f").alias("path"), "version", F.concat(F.lit("a"), F.col("version") % 3).alias("author"), F.concat(F.lit("c"), "version").alias("commit"), "text")


def moved_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of a word a line, before and after some have moved, with a line more or fewer."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("k"), F.col("doc_id").cast("string").alias("id"), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n")).alias("text"))
    before = docs.where("k <> 4").select(F.concat(F.lit("a/"), "id").alias("path"), "text")
    name = F.when(F.col("k") == 0, F.concat(F.lit("b/"), "id")).when(F.col("k") == 4, F.concat(F.lit("c/"), "id")).otherwise(F.concat(F.lit("a/"), "id"))
    text = F.when(F.col("k") == 0, F.concat(F.lit("moved\n"), "text")).when(F.col("k") == 1, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    return before, docs.where("k <> 3").select(name.alias("path"), text.alias("text"))


DOCUMENTS_SQL = """
d AS (
  SELECT concat(source, '/', doc_id % 10, '/doc_', doc_id, '.txt') AS path, lang AS language, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT path, language, lines, unnest(range(1, len(lines) + 1)) AS line_number, unnest(lines) AS line
  FROM (SELECT path, language, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END AS lines FROM d))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree of files, and suppliers as rings of five."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).where("k > 0")
    tree = c.select(F.concat(F.lit("d"), F.col("k") % 40, F.lit("/c"), "k").alias("importer"), F.floor(F.col("k") / 3).alias("p"))
    tree = tree.select("importer", F.concat(F.lit("d"), F.col("p") % 40, F.lit("/c"), "p").alias("importee"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    after = F.floor(F.col("k") / 5) * 5 + (F.col("k") + 1) % 5
    ring = s.select(F.concat(F.lit("s/r"), "k").alias("importer"), F.concat(F.lit("s/r"), after).alias("importee"))
    return tree.unionByName(ring)


EDGES_SQL = """
e AS (
  SELECT DISTINCT importer, importee FROM (
    SELECT concat('d', k % 40, '/c', k) AS importer, concat('d', (k // 3) % 40, '/c', k // 3) AS importee
    FROM (SELECT c_custkey AS k FROM customer) WHERE k > 0
    UNION ALL
    SELECT concat('s/r', s_suppkey), concat('s/r', s_suppkey // 5 * 5 + (s_suppkey + 1) % 5) FROM supplier)
  WHERE importer <> importee),
n AS (
  SELECT DISTINCT node FROM (SELECT importer AS node FROM e UNION ALL SELECT importee FROM e)),
t AS (
  SELECT importee AS node, importer FROM e
  UNION
  SELECT t.node, e.importer FROM t JOIN e ON e.importee = t.importer)"""


def nodes(found: DataFrame) -> DataFrame:
    return found.select(F.col("importer").alias("node")).unionByName(found.select(F.col("importee").alias("node"))).distinct()


TLS_CIPHERS = ["TLS_AES_128_GCM_SHA256", "TLS_RSA_WITH_RC4_128_SHA", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", "TLS_RSA_WITH_NULL_SHA", "TLS_CHACHA20_POLY1305_SHA256"]
TLS_KEYS = ["RSA", "ECDSA-P-256", "Ed25519", "DSA"]
TLS_SIGNATURES = ["SHA1-RSA", "SHA256-RSA", "ECDSA-SHA256"]
AS_OF = "2024-01-01 00:00:00"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as TLS observations."""
    k = F.col("c_custkey")
    after = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF)) + (k % 60 - 10) * 86400)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("h"), k, F.lit(".example:443")).alias("endpoint"), F.lit("TLS 1.2").alias("version"), pick(TLS_CIPHERS, k).alias("cipher"), pick(TLS_KEYS, k).alias("key_alg"),
        (F.lit(1024) + k % 3 * 1024).cast("int").alias("key_bits"), pick(TLS_SIGNATURES, k).alias("sig_alg"), after.alias("not_after"),
        F.concat(F.lit("CN="), k % 7).alias("subject"), F.concat(F.lit("CN="), k % 5).alias("issuer"), (k % 4 == 0).alias("accepts_tls10"), (k % 3 == 0).alias("accepts_tls11"),
    )


PACKAGES = ["cryptography", "PyCrypto", "rsa", "requests", "jsonwebtoken", "node-forge", "left-pad", "golang.org/x/crypto", "github.com/cloudflare/circl", "filippo.io/age", "gopkg.in/yaml.v3"]
ECOSYSTEMS = ["python", "python", "python", "python", "javascript", "javascript", "javascript", "go", "go", "go", "go"]


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declared dependencies."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        pick(ECOSYSTEMS, k).alias("ecosystem"), pick(PACKAGES, k).alias("package"), F.concat(F.lit("=="), "p_size").alias("version"),
        F.concat(F.lit("svc"), k % 50, F.lit("/requirements.txt")).alias("manifest"), (k % 100).cast("int").alias("line"),
    )


#: A self-signed certificate with a key on P-256, made for these queries.
CERTIFICATE = """-----BEGIN CERTIFICATE-----
MIIBejCCAR+gAwIBAgIUXr/TWol4R69RuIheuwNESV3U+QowCgYIKoZIzj0EAwIw
EjEQMA4GA1UEAwwHZXhhbXBsZTAeFw0yNjExMjgwOTMyNDZaFw0zNjExMjUwOTMy
NDZaMBIxEDAOBgNVBAMMB2V4YW1wbGUwWTATBgcqhkjOPQIBBggqhkjOPQMBBwNC
AARqTzjcrwshYLrTZ+1O5EAAfw5M5+UlMdvx+pJ8Ltr3Nxf9nFGEC17q+gu1Y6zH
Ij3GbLP1TX0mpiokcV45HN0No1MwUTAdBgNVHQ4EFgQUcgeImsux3aT4LBEPN1GE
QI/oQUQwHwYDVR0jBBgwFoAUcgeImsux3aT4LBEPN1GEQI/oQUQwDwYDVR0TAQH/
BAUwAwEB/zAKBggqhkjOPQQDAgNJADBGAiEAhu+hSu7VzzuWfTEJS7AAcdMeEhYp
MVIpQ8g26Z7fyJICIQDVQaWI59bHXYVZ064uQBtxANiRpgqhRXSlmEDxm7vzMw==
-----END CERTIFICATE-----
"""
#: Source files: name, and text; {k} is a row's key. With each its findings: rule, line, the text at whose place it is, which
#: occurrence on the line, and the scan's layer (0 structure, 1 pattern, 2 promoted, 3 sentinel).
SOURCES: list[tuple[str, str, list[tuple[str, int, str, int, int]]]] = [
    ("calls.py", 'import hashlib\n# hashlib.md5(b"no")\ns = "hashlib.md5(b\'no\')"\ndef f{k}(x):\n    return [hashlib.md5(bytes([i])) for i in x]\n',
     [("PY_MD5_CALL", 2, "hashlib", 1, 1), ("PY_MD5_CALL", 3, "hashlib", 1, 1), ("PY_MD5_CALL", 5, "hashlib", 1, 1), ("PY_MD5_STRUCTURE", 5, "hashlib", 1, 0)]),
    ("quiet.py", 'import hashlib\n# crypto-ignore: PY_MD5_CALL\na = hashlib.md5(b"{k}")\nb = hashlib.sha1(b"")  # crypto-ignore\n', [("PY_MD5_STRUCTURE", 3, "hashlib", 1, 0)]),
    ("curve.go", 'package main\nimport "crypto/elliptic"\nvar v{k} = elliptic.P256()\n', [("CRYPTO_API_UNMAPPED", 2, '"crypto', 1, 3)]),
    ("hash.go", 'package main\nimport "crypto/md5"\n// md5.New()\nvar s = "md5.New()"\nfunc f{k}() { h := wrap(md5.New()); _ = h }\n', [("GO_MD5_STRUCTURE", 5, "md5", 1, 0)]),
    ("hash.js", 'const c = require("crypto");\n/* createHash("md5") */ const h = c.createHash("MD5"); // {k}\nconst e = new EC("p256"); // new EC(1)\n',
     [("JS_CREATE_HASH_MD5", 2, "createHash", 1, 1), ("JS_CREATE_HASH_MD5", 2, "createHash", 2, 1), ("JS_ELLIPTIC_STRUCTURE", 3, "new", 1, 0)]),
    ("hand.py", "K = 0x6a09e667\ndef s{k}(w): return rotr(w, 7) ^ rotr(w, 18)\n",
     [("ANY_SHA256_CONSTANTS", 1, "0x", 1, 1), ("ANY_SHA256_SIGMA", 2, "rotr", 1, 1), ("HANDROLLED_SHA256_PROMOTED", 1, "0x", 1, 2)]),
    ("book.ipynb", '{{"cells":[{{"cell_type":"markdown","source":"# {k}"}},{{"cell_type":"code","source":["import hashlib\\n","h = hashlib.md5()"]}}]}}', [("PY_MD5_STRUCTURE", 2, "", 5, 0)]),
    ("own.pem", CERTIFICATE, [("X509_CERT_PUBKEY_ECDSA", 1, "", 1, 0), ("X509_CERT_SIG_ECDSA", 1, "", 1, 0)]),
    ("vendor/calls.py", 'hashlib.md5(b"{k}")\n', []),
    ("data.py", "hashlib.md5(\0{k})\n", []),
    ("dh.ts", 'const a: Map<string, number> = new Map();\nconst d{k} = `crypto.createDiffieHellman(1)`;\nexport const e = f(crypto.createDiffieHellman(2048));\n', [("TS_DH_STRUCTURE", 3, "crypto", 1, 0)]),
    ("Keys.java", 'class K{k} {{\n  // KeyPairGenerator.getInstance("RSA")\n  List<Map<String, Key>> m = List.of(KeyPairGenerator.getInstance("RSA"));\n}}\n', [("JAVA_KEYGEN_STRUCTURE", 3, "KeyPair", 1, 0)]),
    ("Digest.kt", 'fun f{k}(): List<Byte> {{ /* MessageDigest.getInstance("MD5") */ return MessageDigest.getInstance("MD5").digest().toList() }}\n', None),
    ("hash.swift", "let s = \"Insecure.MD5.hash(data)\"\nlet d{k} = wrap(Insecure.MD5.hash(data: x))\n", None),
    ("md.c", '#include <openssl/md5.h>\n/* MD5_Init(\n MD5_Init(&a) */\nint f{k}(void) {{ return MD5_Init(&c); }}\n', None),
    ("key.cpp", 'template <typename T> int g(T t);\nauto r = g<RSA*>(nullptr); // {k}\nint x = RSA_generate_key_ex(r, 2048, e, 0);\nconst char* s = "RSA_generate_key_ex(r)";\n', None),
    ("key.rs", 'use rsa::RsaPrivateKey;\n// RsaPrivateKey::new(\nfn f{k}() -> Option<RsaPrivateKey> {{\n    RsaPrivateKey::new(&mut rng, 2048).ok()\n}}\n', None),
    ("Cipher.scala", 'val m: Map[String, Int] = Map() // {k}\nval c = List(1).map(_ => Cipher.getInstance("DES"))\n', None),
    ("Rsa.cs", '/// new RSACryptoServiceProvider()\nvar s{k} = "new RSACryptoServiceProvider()";\nusing (var r = new RSACryptoServiceProvider(2048)) {{ }}\n', None),
    ("des.rb", "# OpenSSL::Cipher::DES.new\nx{k} = OpenSSL::Cipher::DES.new(:CBC)\n", None),
    ("md.php", "<?php\n// md5($a)\n$s = 'md5(1)';\n$h{k} = trim(md5($a));\n", None),
    ("md.jl", "# md5(x)\nh = bytes2hex(md5(x)) # {k}\n", None),
]
#: The one finding of the files of None: its rule, line, the text at whose place it is, and which occurrence on the line.
SINGLE = {
    "Digest.kt": ("KT_DIGEST_STRUCTURE", 1, "MessageDigest", 2, 0), "hash.swift": ("SWIFT_INSECURE_STRUCTURE", 2, "Insecure", 1, 0), "md.c": ("C_MD5_STRUCTURE", 4, "MD5_Init", 1, 0),
    "key.cpp": ("CPP_RSA_STRUCTURE", 3, "RSA_", 1, 0), "key.rs": ("RUST_RSA_STRUCTURE", 4, "Rsa", 1, 0), "Cipher.scala": ("SCALA_CIPHER_STRUCTURE", 2, "Cipher", 1, 0), "Rsa.cs": ("CS_RSA_STRUCTURE", 3, "new", 1, 0),
    "des.rb": ("RB_DES_STRUCTURE", 2, "OpenSSL", 1, 0), "md.php": ("PHP_MD5_STRUCTURE", 4, "md5", 1, 0), "md.jl": ("JL_MD5_STRUCTURE", 2, "md5", 1, 0),
}

#: Texts in which names stand in code, in strings, and in code in strings: language, query, text, and the places (line, byte
#: column) where the query is met.
STRUCTURES: list[tuple[str, str, str, list[tuple[int, int]]]] = [
    # lifetimes and characters, transposes, type arguments in type arguments, code in strings and none
    ("rust", "call:RsaPrivateKey::new", "let x: &'a T = RsaPrivateKey::new(&mut r); let y: &'a str;\n", [(1, 16)]),
    ("rust", "call:RsaPrivateKey::new", "fn f<'a>(x: T) { RsaPrivateKey::new(&mut r, 2048); let q = '\"'; RsaPrivateKey::new(1); let s = r#\"RsaPrivateKey::new(\"#; }\n", [(1, 18), (1, 65)]),
    ("rust", "call:new_key", "let a = new_key::<Vec<Option<u8>>>(1);\nlet b = new_key!(2);\nfn new_key(x: u8) {}\n", [(1, 9), (2, 9)]),
    ("julia", "call:md5", "x = A' * md5(b) * B'\nc = 'm'; d = \"md5(1) $(md5(2)) \"\n#= md5(3)\nmd5(4) =# md5(5)\n", [(1, 10), (2, 24), (4, 11)]),
    ("java", "call:KeyGen", "var k = KeyGen<List<Map<String, Integer>>>(1);\nif (KeyGen < 3 && x > (2)) {}\nchar c = '\"'; KeyGen(2); // KeyGen(3)\nString t = \"\"\"\nKeyGen(4)\n\"\"\"; KeyGen(5);\n", [(1, 9), (3, 15), (6, 6)]),
    ("kotlin", "call:KeyGen", "val k = KeyGen<List<List<String>>>(1)\nval s = \"KeyGen(2) ${wrap(KeyGen(3))}\"\n", [(1, 9), (2, 27)]),
    ("typescript", "call:f", "const a = f<Map<string, Array<number>>>(1);\nconst b = `f(2) ${f(3)} ${g(`f(4) ${f(5)}`)}`;\nconst c = /f(6)/.test(x), d = a / f(7) / 2;\n", [(1, 11), (2, 19), (2, 37), (3, 35)]),
    ("javascript", "call:c.createHash", "const h = `${c.createHash('md5')} c.createHash(1)`;\nx = '\\'' + c.createHash(2) // `\n", [(1, 14), (2, 12)]),
    ("javascript", "import:crypto", "import {\n  createHash,\n} from 'crypto';\n", [(3, 1)]),
    ("swift", "call:Insecure.MD5.hash", "let s = \"a \\(Insecure.MD5.hash(data: x)) Insecure.MD5.hash(1)\"\nlet d = \"\"\"\nInsecure.MD5.hash(2)\n\"\"\"\n", [(1, 14)]),
    ("scala", "call:KeyGen", "val a = KeyGen[List[Map[Int, String]]](1)\nval s = s\"KeyGen(2) ${KeyGen(3)}\"\nval t = \"\"\"KeyGen(4)\"\"\"\n", [(1, 9), (2, 23)]),
    ("go", "call:gen.Key", "k := gen.Key[map[string]int](1)\nr := '\"'; gen.Key(2)\nt := `gen.Key(3)\n`\nother.gen.Key(4)\n", [(1, 6), (2, 11)]),
    ("csharp", "new:MD5CryptoServiceProvider", "var s = $\"{new MD5CryptoServiceProvider()} {{new MD5CryptoServiceProvider()}}\";\nvar t = @\"new MD5CryptoServiceProvider(\"\"x\"\")\"; var u = new System.Security.MD5CryptoServiceProvider();\n", [(1, 12), (2, 57)]),
    ("cpp", "call:RSA_new", "int n = 1'000'000; RSA_new(n);\nauto s = R\"x(RSA_new(2) \" )x\"; auto c = '\"'; RSA_new(3);\nauto f = RSA_new<std::vector<std::pair<int, int>>>(4); std::cout << RSA_new(5) << 1;\n", [(1, 20), (2, 46), (3, 10), (3, 69)]),
    ("c", "call:MD5_Init", "char *s = \"a \\\\\"; MD5_Init(&c); /* MD5_Init(\n*/ char q = '\\''; MD5_Init(&d);\n", [(1, 19), (2, 19)]),
    ("ruby", "call:Digest::MD5.hexdigest", "a = <<~TEXT + Digest::MD5.hexdigest(x)\n  Digest::MD5.hexdigest(1) #{Digest::MD5.hexdigest(y)}\nTEXT\nb = <<-'RAW'\n#{Digest::MD5.hexdigest(2)}\nRAW\nc = \"it's #{Digest::MD5.hexdigest(z)} x\" # Digest::MD5.hexdigest(3)\nd = %w[Digest::MD5.hexdigest(4)]\n=begin\nDigest::MD5.hexdigest(5)\n=end\n", [(1, 15), (2, 30), (7, 13)]),
    ("ruby", "new:Cipher", "x = OpenSSL::Cipher.new(1)\ny = Cipher.new\n", [(1, 14), (2, 5)]),
    ("php", "call:md5", "$a = <<<EOT\nmd5(1)\nEOT;\n$b = <<<'NOW'\nmd5(2)\n  NOW . md5($x);\n$c = \"md5(3) {$h->md5(4)} \" . \\md5($y); ?>\nmd5(5)\n<?php md5($z);\nfunction md5($q) {}\n", [(6, 9), (7, 32), (9, 7)]),
    ("php", "new:RSA", "$r = new \\phpseclib\\Crypt\\RSA(1);\n$s = new RSA;\n", [(1, 6), (2, 6)]),
    ("python", "call:hashlib.md5", "x = f\"{hashlib.md5(a)} hashlib.md5(b) {{hashlib.md5(c)}}\"\ny = \"\"\"hashlib.md5(d)\"\"\" + rb'hashlib.md5(e)'\nz = x.hashlib.md5(f)\n@hashlib.md5(g)\ndef md5(h): pass\n", [(1, 8), (4, 2)]),
    ("python", "import:Crypto.Cipher", "import os, Crypto.Cipher.AES as a\n    from Crypto.Cipher import DES\nfrom x import Crypto\nimport Crypto\n", [(1, 1), (2, 5)]),
]


def structured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files (case, path, language, text), one of STRUCTURES each, in turn."""
    k = F.col("p_partkey")
    text = F.concat(pick([t for _, _, t, _ in STRUCTURES], k), k.cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "part").select((k % len(STRUCTURES)).cast("int").alias("case"), F.concat(F.lit("s"), k).alias("path"), pick([x for x, _, _, _ in STRUCTURES], k).alias("language"), text.alias("text"))


def structure_rules(spark: SparkSession) -> DataFrame:
    """A rule for the query of each of STRUCTURES."""
    rows = [{"rule_ordinal": n, "rule_id": f"{lang}-{n}", "language": lang, "detector_type": "ast", "query": query} for n, (lang, query, _, _) in enumerate(STRUCTURES)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RULE_SCHEMA) for r in rows], RULE_SCHEMA)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files (path, size, content), one of SOURCES each, in turn."""
    k = F.col("p_partkey")
    text = F.replace(pick([t.replace("{{", "{").replace("}}", "}") for _, t, _ in SOURCES], k), F.lit("{k}"), k.cast("string"))
    path = F.concat(F.lit("p"), k, F.lit("/"), pick([n for n, _, _ in SOURCES], k))
    path = F.when(F.contains(path, F.lit("vendor/")), F.concat(F.lit("vendor/"), path)).otherwise(path)
    found = table(spark, sf_dir, "part").select(path.alias("path"), text.cast("binary").alias("content"))
    return found.select("path", F.length("content").cast("long").alias("size"), "content")


def source_places() -> list[tuple[int, str, str, int, int, int, int]]:
    """Number and name of a source, and a finding's rule, line, column (without the key's letters, if they stand before it),
    layer, and whether they do."""
    out = []
    for n, (name, text, found) in enumerate(SOURCES):
        for rule, line, at, nth, layer in found if found is not None else [SINGLE[name]]:
            own, place = text.split("\n")[line - 1].replace("{{", "{").replace("}}", "}") if at else "", -1
            for _ in range(nth if at else 0):
                place = own.index(at, place + 1)
            keyed = int("{k}" in own[: max(place, 0)])
            out.append((n, name, rule, line, place + 1 - 3 * keyed if at else nth, layer, keyed))
    return out


PROJECTS = [
    ("Pipfile", '[source]\nurl = "x"\n[packages]\npkg{k} = "*"\n"Quoted" = "==1.{k}"\n# note = "1"\n[dev-packages]\npython = "3"\ndev = ">=2"\n'),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "alpha{k}>=1.0",\n  "beta[extra] == 2 ; python_version > \'3\'",\n]\n[tool.poetry.dependencies]\npython = "^3.9"\ngamma = "^{k}"\n'),
    ("package.json", '{\n  "name": "p{k}",\n  "dependencies": {"left{k}": "^1.0"},\n  "devDependencies": {\n    "jest": "29"\n  }\n}\n'),
]


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as manifests (path, text), one of PROJECTS each."""
    k = F.col("s_suppkey")
    text = F.replace(pick([t for _, t in PROJECTS], k), F.lit("{k}"), k.cast("string"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), k, F.lit("/"), pick([n for n, _ in PROJECTS], k)).alias("path"), text.alias("text"))


def importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as Python, TypeScript and Go files that import their neighbours, and one in a folder that is left out."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    near = lambda d: (k + d).cast("string")
    python = (
        F.when(k % 4 == 0, F.concat(F.lit("import os, sys\nimport lib.s"), near(1), F.lit("\n")))
        .when(k % 4 == 1, F.concat(F.lit("from . import s"), near(2), F.lit(", s"), near(3), F.lit(" as other  # both\n")))
        .when(k % 4 == 2, F.concat(F.lit("def f():\n    from lib.s"), near(-1), F.lit(" import (f)\n")))
        .otherwise(F.lit("import os\n# import lib.s1\n"))
    )
    script = F.concat(F.lit("import x from './j"), near(1), F.lit("';\nconst y = require(\"../lib/none\");\nimport z from 'j1';\n"))
    module = F.concat(F.lit('package g\nimport (\n\t"fmt"\n\tq "example.com/pkg/g'), near(1), F.lit('"\n)\n'))
    kinds = [("lib/s", ".py", python), ("web/j", ".ts", script), ("pkg/g", "/m.go", module), ("node_modules/n", ".py", F.concat(F.lit("import lib.s"), near(0)))]
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(a), k, F.lit(z)).alias("path"), t.alias("text")) for a, z, t in kinds]))
    return s.select(each.alias("f")).select("f.path", "f.text")


#: A fingerprint that no scan has seen for longer is gone.
PATIENCE_MS = 12 * 3_600_000


def score_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings that hourly scans see: a user is a fingerprint, and has the largest tenth of its values as score.
    Hours count from the epoch, whatever the session's time zone."""
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    return rows.select(F.timestamp_millis(hour * 3_600_000).alias("scanned_at"), F.concat(F.lit("u"), "user_id").alias("fingerprint"), F.floor(F.col("value") / 10).cast("double").alias("score"))
