"""Tables of the data set and the relations derived from them, once for Spark and once as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")
DAY = 86_400
#: 2024-01-01, in seconds.
EPOCH = 1_704_067_200

#: Derived relations in the SQL that both engines read; SECONDS(x) stands for the seconds of a timestamp.
DERIVED = {
    "messages": f"""SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, conv_id % 10 AS organization_id, role AS sender_user_id,
        CASE WHEN turn % 5 = 4 THEN 'call' ELSE 'text' END AS message_type, text AS body, (conv_id + turn) % 11 = 0 AS deleted,
        {EPOCH} + conv_id * 3600 + turn * 60 AS created_s, role || '-' || CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING) AS client_message_id FROM conversations""",
    "conversation_members": """SELECT DISTINCT conv_id AS conversation_id, conv_id % 10 AS organization_id, role AS user_id, 'active' AS status FROM conversations
        UNION ALL SELECT DISTINCT conv_id, conv_id % 10, 'observer', CASE WHEN conv_id % 13 = 0 THEN 'removed' ELSE 'active' END FROM conversations WHERE conv_id % 2 = 0""",
    "rooms": f"""SELECT conv_id AS id, conv_id % 10 AS organization_id, CASE WHEN conv_id % 3 = 0 THEN 'direct' ELSE 'group' END AS type,
        CASE WHEN conv_id % 7 = 0 THEN NULL ELSE {EPOCH} + conv_id * 3600 + max(turn) * 60 END AS last_message_s, {EPOCH} + conv_id * 60 AS updated_s FROM conversations GROUP BY conv_id""",
    "read_state": """SELECT m.conversation_id, m.user_id, m.conversation_id * 1000 + CAST(floor(t.last / 2) AS BIGINT) AS last_read_message_id
        FROM conversation_members m JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) t ON t.conv_id = m.conversation_id WHERE m.conversation_id % 5 <> 0""",
    "policies": """SELECT DISTINCT conv_id % 10 AS organization_id, conv_id % 10 % 3 = 0 AS legal_hold, conv_id % 10 % 2 = 0 AS push_enabled, conv_id % 10 % 3 = 1 AS previews_enabled
        FROM conversations WHERE conv_id % 10 % 4 <> 3""",
    "organizations": f"SELECT n_nationkey AS id, n_name AS name, 5 + n_nationkey % 7 AS max_accounts, {EPOCH} AS updated_s FROM nation",
    "organization_members": f"""SELECT c_custkey AS id, c_nationkey AS organization_id, c_custkey AS user_id, c_name AS member_name,
        CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) THEN 'owner' WHEN c_custkey % 6 = 0 THEN 'admin' ELSE 'member' END AS role,
        CASE WHEN c_custkey % 10 < 7 THEN 'active' WHEN c_custkey % 10 < 9 THEN 'invited' ELSE 'removed' END AS status, {EPOCH} + c_custkey * 60 AS created_s FROM customer""",
    "subscriptions": f"""SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'business' WHEN o_orderkey % 3 = 1 THEN 'personal' ELSE 'enterprise' END AS plan,
        CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'past_due' ELSE 'cancelled' END AS status, SECONDS(o_orderdate) AS period_start_s, SECONDS(o_orderdate) + 30 * {DAY} AS period_end_s,
        CAST(round(o_totalprice * 100) AS BIGINT) AS amount, 1 + o_orderkey % 9 AS seats, o_orderkey % 4 = 0 AS cancel_at_period_end,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE SECONDS(o_orderdate) + 40 * {DAY} END AS last_reconciled_s, CASE WHEN o_orderkey % 11 = 0 THEN 'quarantined' END AS reconciliation_error,
        CASE WHEN o_orderkey % 2 = 0 THEN 'stripe' ELSE 'paystack' END AS provider FROM orders""",
    "forms": """SELECT c_custkey AS doc_id, 'Full Name: ' || nm || chr(10) || 'Date of Birth: ' || CAST(1 + c_custkey % 28 AS STRING) || '/0' || CAST(1 + c_custkey % 9 AS STRING) || '/19' || CAST(50 + c_custkey % 50 AS STRING)
        || chr(10) || 'Age: ' || CAST(c_custkey % 140 AS STRING) || chr(10) || 'Account Number: ' || CAST(1000000000 + c_custkey * 7919 AS STRING) || chr(10) || 'NIN: ' || CAST(10000000000 + c_custkey * 104729 AS STRING)
        || chr(10) || 'TIN: ' || CAST(100000 + c_custkey AS STRING) || '-0001' || chr(10) || 'Passport No: A' || CAST(1000000 + c_custkey AS STRING) || chr(10) || 'Phone: +1 212 555 ' || CAST(1000 + c_custkey % 9000 AS STRING)
        || chr(10) || 'Card: 4111 1111 1111 ' || CASE c_custkey % 2 WHEN 0 THEN '1111' ELSE '1112' END || chr(10) || 'Address: ' || CAST(c_custkey AS STRING) || ' Main Street' || chr(10) || 'Lagos, Nigeria'
        || chr(10) || 'Signed by: ' || nm || chr(10) || 'Contact: p' || CAST(c_custkey AS STRING) || '@mail.example.com' AS text FROM (
        SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ada Obi' WHEN 1 THEN 'Jean Dupont' WHEN 2 THEN 'Maria Santos' ELSE 'Li Wei' END AS nm FROM customer) AS named""",
    "record_text": """SELECT o_orderkey AS doc_id, 'Invoice No: INV-' || CAST(o_orderkey AS STRING) || chr(10) || 'Customer: C' || CAST(o_custkey AS STRING) || chr(10) || 'Date: ' || CAST(1 + o_orderkey % 28 AS STRING) || '/03/2024'
        || chr(10) || 'Total: $' || CAST(o_orderkey * 3 AS STRING) || '.50' || chr(10) || 'Widget ' || o_orderpriority || ' ' || CAST(1 + o_orderkey % 9 AS STRING) || ' 10.50 ' || CAST(o_orderkey % 90 AS STRING) || '.00'
        || chr(10) || '03/04/2024 Transfer fee ' || CAST(o_orderkey % 900 AS STRING) || '.00 1500.00' || chr(10) || '1.' || CAST(o_orderkey % 5 AS STRING) || ' Scope of work' || chr(10)
        || chr(10) || 'Item' || chr(9) || 'Quantity' || chr(9) || 'Amount' || chr(10) || 'bolt' || chr(9) || CAST(o_orderkey % 7 AS STRING) || chr(9) || '=5' || chr(10) || 'nut' || chr(9) || '2' || chr(9) || CAST(o_orderkey % 11 AS STRING)
        || chr(10) || chr(10) || 'Name: Ann' || chr(10) || 'Role: clerk' || chr(10) || 'Name: Bob' || chr(10) || 'Role: ' || CASE o_orderkey % 2 WHEN 0 THEN 'cook' ELSE 'clerk' END || chr(10) || chr(10) || 'Delivery Site' || chr(10) || 'Dock ' || CAST(o_custkey % 40 AS STRING)
        || chr(10) || 'Total: $' || CAST(o_orderkey * 3 + o_orderkey % 2 AS STRING) || '.50' AS text FROM orders""",
    "clock": f"SELECT max(SECONDS(o_orderdate)) - 90 * {DAY} AS now_s FROM orders",
    "collection_jobs": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS account_id, CASE WHEN l_linenumber % 3 = 0 THEN 'renewal' ELSE 'seat' END AS purpose,
        CASE l_returnflag WHEN 'R' THEN 'review' WHEN 'A' THEN 'open' ELSE 'done' END AS status, SECONDS(l_shipdate) AS next_attempt_s, SECONDS(l_shipdate) + 13 * {DAY} AS deadline_s,
        l_linenumber - 1 AS attempts, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem""",
    "audit_events": """SELECT id, organization_id, event_type, actor, canonical, event_hash, CASE WHEN id % 97 = 0 THEN 'tampered' ELSE lag(event_hash) OVER (PARTITION BY organization_id ORDER BY id) END AS previous_hash FROM (
        SELECT event_id AS id, user_id % 10 AS organization_id, event_type, user_id AS actor, CAST(event_id AS STRING) || '|' || CAST(user_id AS STRING) || '|' || event_type AS canonical,
        CASE WHEN event_id % 101 = 0 THEN 'flipped' ELSE SHA256(CAST(event_id AS STRING) || '|' || CAST(user_id AS STRING) || '|' || event_type) END AS event_hash FROM events) AS e""",
    "outbox": """SELECT event_id AS id, event_type || '-' || CAST(user_id % 20 AS STRING) AS aggregate_id, event_type, SECONDS(ts) AS available_s, event_id % 7 AS attempts,
        CASE WHEN event_id % 4 = 0 THEN 'delivered' ELSE 'pending' END AS status, CASE WHEN event_id % 9 = 0 THEN SECONDS(ts) + 60 END AS locked_s FROM events""",
    "calls": """SELECT id, conversation_id, organization_id, sender_user_id AS created_by, created_s, CASE CAST(floor(id / 5) AS BIGINT) % 5 WHEN 0 THEN 'ringing' WHEN 1 THEN 'active' WHEN 2 THEN 'missed' ELSE 'ended' END AS status,
        created_s + 30 AS ringing_expires_s, CASE WHEN CAST(floor(id / 5) AS BIGINT) % 5 = 1 THEN created_s + 3600 END AS scheduled_end_s, CASE WHEN id % 7 = 0 THEN created_s + 90 END AS provider_finished_s FROM messages WHERE message_type = 'call'""",
    "call_participants": """SELECT c.id AS call_id, c.organization_id, m.user_id, CASE (c.id + length(m.user_id)) % 4 WHEN 0 THEN 'joined' WHEN 1 THEN 'missed' WHEN 2 THEN 'left' ELSE 'invited' END AS status,
        (c.id + length(m.user_id)) % 3 <> 0 AS consented FROM calls c JOIN conversation_members m ON m.conversation_id = c.conversation_id""",
    "attachments": f"""SELECT page_id AS id, page_id % 40 AS conversation_id, page_id % 10 AS organization_id, length(html) AS file_size_bytes, SHA256(html) AS checksum, {EPOCH} + page_id * 7200 AS created_s, url AS filename FROM pages""",
    "call_links": f"SELECT o_orderkey AS id, SECONDS(o_orderdate) AS start_s, 15 + o_orderkey % 46 AS duration_minutes, CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 17 = 0 THEN 'completed' ELSE 'scheduled' END AS status FROM orders",
}
#: What a derived relation reads besides the base tables.
NEEDS = {"read_state": ["conversation_members"], "calls": ["messages"], "call_participants": ["calls", "conversation_members"]}


def load(spark: SparkSession, sf_dir: str, name: str, deal: bool = False, short: bool = False) -> DataFrame:
    """A base table, or a derived one; to ``deal`` it out is to deal out the rows that it is made of, which are shorter."""
    if name in BASE:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(rows, short) if deal else rows
    text = _seconds(DERIVED[name], "unix_seconds(CAST({} AS TIMESTAMP))").replace("SHA256(", "sha2_256(")
    text = _calls(text, "sha2_256", "sha2({}, 256)")
    used = {t: load(spark, sf_dir, t, deal, True) for t in [*BASE, *DERIVED] if t != name and _reads(text, t)}
    for t in sorted(used, key=len, reverse=True):
        text = _rename(text, t, "{" + t + "}")
    return spark.sql(text, **used)


#: Tables of texts, whose rows cost much more than their bytes.
TEXTS = ("documents", "forms", "record_text", "pages", "conversations")


#: A table of at most so many files and bytes is small; a single row group of it would keep one core busy.
SMALL_FILES, SMALL_BYTES = 64, 256 * 2**20


#: Bytes in the files to a part, where short rows of which texts are made are dealt out.
SHORT_BYTES = 4 * 2**20


def spread(rows: DataFrame, short: bool = False) -> DataFrame:
    """Texts of a small table dealt out over the cores; larger ones are split by the reader and stay where they are.

    ``short`` rows, of which texts are made later, are dealt out whatever the size: what the reader
    takes at once of them makes texts for one core many times as long.
    """
    spark, files = rows.sparkSession, rows.inputFiles()
    if len(files) > SMALL_FILES:
        return rows
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    parts = min(spark.sparkContext.defaultParallelism, 64)
    if short:
        parts = max(parts, -(-size // SHORT_BYTES))
    return rows.repartition(parts) if short or size <= SMALL_BYTES else rows


def _reads(text: str, table: str) -> bool:
    return any(f"{word} {table}{end}" in f"{text} " for word in ("FROM", "JOIN") for end in (" ", ")", "\n"))


def _rename(text: str, table: str, to: str) -> str:
    for word in ("FROM", "JOIN"):
        for end in (" ", ")", "\n"):
            text = f"{text} ".replace(f"{word} {table}{end}", f"{word} {to}{end}").strip()
    return text


def _calls(text: str, function: str, form: str) -> str:
    """Replace function(x) by a form of x, with nested brackets."""
    while (at := text.find(f"{function}(")) >= 0:
        depth, i = 1, at + len(function) + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:at] + form.format(text[at + len(function) + 1 : i - 1]) + text[i:]
    return text


def _seconds(text: str, form: str) -> str:
    return _calls(text, "SECONDS", form)


def with_sql(sql: str, *names: str) -> str:
    """SQL for checks that reads derived relations by name."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = ",\n".join(f"{n} AS ({_seconds(DERIVED[n], 'CAST(floor(epoch({})) AS BIGINT)').replace('SHA256(', 'sha256(')})" for n in order)
    return f"WITH {parts}\n{sql}" if parts else sql
