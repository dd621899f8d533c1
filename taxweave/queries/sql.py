"""The fixtures and intermediate tables as SQL, for the checking database.

`sql("...", "a", "b")` puts the named tables, and those they need, before a
statement.
"""

from __future__ import annotations

SOURCE = "taxpayer_id, store, platform"

TABLES = {
    "sales_rows": """
SELECT l_orderkey, o_custkey // 15 AS taxpayer_id,
       'store' || CAST((l_orderkey // 3) % 3 + 1 AS VARCHAR) AS store,
       CASE l_orderkey % 3 WHEN 0 THEN 'Shopee' WHEN 1 THEN 'Lazada' ELSE 'TikTok' END AS platform,
       CAST(l_orderkey AS VARCHAR) AS order_no, o_orderstatus, CAST(o_orderdate AS DATE) AS order_date,
       'Customer#' || CAST(o_custkey AS VARCHAR) AS customer_name,
       item_c, (item_c * rate + 50) // 100 AS disc_c,
       CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE quantity * 100 END AS ship_c,
       CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS sku, quantity,
       l_returnflag = 'R' AS returned,
       CAST(l_linenumber AS BIGINT) * 1000000000000000
         + (l_partkey * 1000003 + l_suppkey * 10007 + item_c * 101 + quantity * 17 + rate) % 1000000000000000 AS line_ord,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS item_c, CAST(round(l_discount * 100) AS BIGINT) AS rate,
             CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
JOIN orders ON l_orderkey = o_orderkey""",
    "lines": """
SELECT * REPLACE (CASE WHEN platform = 'Shopee' AND l_orderkey % 41 = 0 THEN NULL ELSE disc_c END AS disc_c),
       CASE o_orderstatus
         WHEN 'P' THEN CASE platform WHEN 'Shopee' THEN 'ยกเลิกแล้ว' WHEN 'TikTok' THEN 'Canceled'
           ELSE CASE (l_orderkey // 9) % 3 WHEN 0 THEN 'canceled' WHEN 1 THEN 'returned' ELSE 'Package Returned' END END
         WHEN 'F' THEN CASE platform WHEN 'Shopee' THEN 'สำเร็จแล้ว' WHEN 'Lazada' THEN 'confirmed' ELSE 'Completed' END
         ELSE CASE WHEN l_orderkey % 29 <> 0 THEN
           CASE platform WHEN 'Shopee' THEN 'ที่ต้องจัดส่ง' WHEN 'Lazada' THEN 'shipped' ELSE 'To ship' END END
       END AS status
FROM sales_rows, (VALUES (1), (2)) AS twice(copy) WHERE copy = 1 OR l_orderkey % 50 = 0""",
    "kept": """
SELECT * FROM lines WHERE status IS NULL
   OR status NOT IN ('ยกเลิกแล้ว', 'canceled', 'returned', 'Package Returned', 'Canceled')""",
    "deduped": f"""
SELECT {SOURCE}, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month,
       min(line_ord) AS line_ord, count(*) AS copies
FROM kept GROUP BY {SOURCE}, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month""",
    "order_day": f"""
SELECT {SOURCE}, order_date, order_no,
       CAST(sum(item_c * times) - CASE platform WHEN 'Shopee' THEN coalesce(max(CASE WHEN place = 1 THEN disc_c END), 0)
         WHEN 'TikTok' THEN coalesce(sum(disc_c * times), 0) ELSE 0 END AS BIGINT) AS order_c,
       CAST(CASE WHEN platform = 'Lazada' THEN 0 ELSE coalesce(max(CASE WHEN place = 1 THEN ship_c END), 0) END AS BIGINT) AS ship_c
FROM (SELECT *, CASE WHEN platform = 'Lazada' THEN copies ELSE 1 END AS times,
             row_number() OVER (PARTITION BY {SOURCE}, order_date, order_no ORDER BY line_ord) AS place FROM deduped)
GROUP BY {SOURCE}, order_date, order_no""",
    "daily": f"""
SELECT {SOURCE}, order_date AS date, CAST(sum(order_c) AS BIGINT) AS order_c, CAST(sum(ship_c) AS BIGINT) AS ship_c
FROM order_day GROUP BY {SOURCE}, order_date""",
    "totals": """
SELECT taxpayer_id, date, CAST(sum(order_c + ship_c) AS BIGINT) AS sum_c FROM daily GROUP BY taxpayer_id, date""",
    "running": """
SELECT taxpayer_id, CAST(year(date) AS INTEGER) AS year, date, sum_c,
       CAST(sum(sum_c) OVER (PARTITION BY taxpayer_id, year(date) ORDER BY date) AS BIGINT) AS cum_c FROM totals""",
    "orders_vat": f"""
SELECT {SOURCE}, year, month, order_no,
       min(CASE WHEN place = 1 THEN order_date END) AS order_date, min(CASE WHEN place = 1 THEN status END) AS status,
       min(CASE WHEN place = 1 THEN customer_name END) AS customer_name,
       CAST(sum(item_c) - CASE platform WHEN 'Shopee' THEN coalesce(max(CASE WHEN place = 1 THEN disc_c END), 0)
         WHEN 'TikTok' THEN coalesce(sum(disc_c), 0) ELSE 0 END AS BIGINT) AS goods_c,
       CAST(CASE WHEN platform = 'Lazada' THEN 0 ELSE coalesce(max(CASE WHEN place = 1 THEN ship_c END), 0) END AS BIGINT) AS service_c
FROM (SELECT *, row_number() OVER (PARTITION BY {SOURCE}, year, month, order_no ORDER BY line_ord) AS place FROM deduped)
GROUP BY {SOURCE}, year, month, order_no""",
    "sales": f"""
SELECT {SOURCE}, year, month, type, order_date, status, order_no, customer_name,
       include_vat_c - vat_c AS before_vat_c, vat_c, include_vat_c
FROM (SELECT *, CAST(sign(include_vat_c) AS BIGINT) * ((14 * abs(include_vat_c) + 107) // 214) AS vat_c
      FROM (SELECT *, 'สินค้า' AS type, goods_c AS include_vat_c FROM orders_vat
            UNION ALL SELECT *, 'บริการ' AS type, service_c AS include_vat_c FROM orders_vat WHERE service_c <> 0))""",
    "selection": f"""
SELECT DISTINCT {SOURCE} FROM sales_rows WHERE platform <> 'TikTok' OR taxpayer_id % 10 <> 0""",
    "manifest": f"""
SELECT {SOURCE}, kind, store || '_' || platform || '_' || kind AS file_name
FROM (SELECT DISTINCT {SOURCE} FROM sales_rows), (VALUES ('sale'), ('commission')) AS k(kind)
WHERE kind = 'sale' OR platform <> 'TikTok' OR taxpayer_id % 2 = 0""",
    "periods": """
SELECT DISTINCT taxpayer_id, year, month FROM sales_rows""",
    "monthly": f"""
SELECT {SOURCE}, year, month, kind
FROM (SELECT DISTINCT {SOURCE} FROM sales_rows) JOIN periods USING (taxpayer_id), (VALUES ('sale'), ('commission')) AS k(kind)
WHERE NOT (kind = 'sale' AND platform = 'Lazada' AND (taxpayer_id % 4 = 1 AND store = 'store2' OR (taxpayer_id + year + month) % 5 = 0))
  AND NOT (kind = 'commission' AND platform = 'TikTok' AND (taxpayer_id + month) % 4 = 0)""",
    "entered": """
SELECT c_custkey // 15 AS taxpayer_id, CASE WHEN c_custkey % 7 = 0 THEN 'shop_' || c_mktsegment
       WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS store FROM customer""",
    "fee_month": f"""
SELECT *, ((taxpayer_id * 3 + CAST(substr(store, 6, 1) AS BIGINT) - 1) * 3
           + CASE platform WHEN 'Shopee' THEN 0 WHEN 'Lazada' THEN 1 ELSE 2 END) * 100000 + year * 12 + month - 1 AS inv_id
FROM (SELECT {SOURCE}, year, month, CAST(sum(item_c) AS BIGINT) AS item_c,
             CAST(sum(CASE WHEN returned THEN item_c ELSE 0 END) AS BIGINT) AS ret_c
      FROM sales_rows GROUP BY {SOURCE}, year, month)""",
    "fee_doc": """
SELECT *, (3 * item_c + 50) // 100 AS fee_c,
       make_date(year, month, CAST(inv_id % 28 + 1 AS INTEGER)) AS own_day, lpad(CAST(taxpayer_id AS VARCHAR), 12, '0') AS number,
       CAST(inv_id AS VARCHAR) AS digits
FROM fee_month JOIN (VALUES ('fee', 0), ('credit', 1), ('copy', 2), ('express', 3), ('late', 4), ('other', 5),
                            ('broken', 6), ('spx', 7), ('journal', 8), ('ads', 9)) AS k(kind, upload_ord)
  ON CASE kind WHEN 'fee' THEN true
       WHEN 'credit' THEN platform = 'Lazada' AND ret_c > 0
       WHEN 'copy' THEN platform = 'Lazada' AND inv_id % 10 = 0
       WHEN 'express' THEN platform = 'Lazada' AND inv_id % 13 = 0
       WHEN 'late' THEN inv_id % 17 = 0
       WHEN 'other' THEN inv_id % 5 = 0
       WHEN 'broken' THEN inv_id % 23 = 0
       WHEN 'spx' THEN platform = 'Shopee' AND inv_id % 11 = 0
       WHEN 'journal' THEN platform = 'TikTok' AND inv_id % 11 = 0
       ELSE platform = 'TikTok' AND inv_id % 19 = 0 END""",
    "invoice": f"""
SELECT {SOURCE}, year, month, inv_id, kind, upload_ord, digits || '-' || kind AS doc_id,
       CASE WHEN kind = 'late' THEN CAST(own_day + INTERVAL 1 MONTH AS DATE) ELSE own_day END AS doc_date,
       CASE WHEN kind = 'other' THEN 'Agency ' ELSE 'Company ' END || CAST(taxpayer_id AS VARCHAR) || ' Limited' AS company_name,
       CASE WHEN kind = 'other' THEN 'TH9' WHEN inv_id % 3 = 0 THEN 'th 0' ELSE 'TH0' END || number AS tax_id,
       CASE platform WHEN 'Shopee' THEN 'Shopee (Thailand) Co., Ltd.' WHEN 'Lazada' THEN 'Lazada Limited'
         ELSE 'TikTok Shop (Thailand) Ltd.' END AS issuer,
       CASE WHEN platform = 'Shopee' THEN 'TRS' || digits || ' S-' || kind WHEN platform = 'TikTok' THEN 'TTS' || digits || '-' || kind
         WHEN kind = 'credit' THEN 'CN' || digits WHEN kind IN ('fee', 'copy') THEN 'THMP' || digits
         ELSE 'THMP' || digits || '-' || kind END AS doc_num,
       CASE WHEN platform = 'Shopee' THEN CASE WHEN kind = 'spx' THEN 'Shopee-SPX-TRS-' ELSE 'Shopee-TIV-TRS-' END
           || digits || '-' || lpad(CAST(upload_ord + 1 AS VARCHAR), 5, '0') || '-' || kind || '.pdf'
         WHEN kind = 'journal' THEN 'THJV' || digits || '.pdf' WHEN kind = 'ads' THEN 'TTSTHAC' || digits || '.pdf'
         ELSE digits || '_' || kind || '.pdf' END AS file_name,
       net_c AS before_vat_c, CASE WHEN net_c < 0 THEN -1 ELSE 1 END * ((7 * abs(net_c) + 50) // 100) AS vat_c
FROM (SELECT *, CASE kind WHEN 'credit' THEN -((3 * ret_c + 50) // 100) WHEN 'copy' THEN fee_c + 100
                  WHEN 'other' THEN fee_c // 2 ELSE fee_c END AS net_c FROM fee_doc)""",
    "page": """
SELECT *, CASE WHEN platform = 'Shopee' THEN 'shopee' WHEN platform = 'TikTok' THEN 'tiktok' WHEN kind = 'express' THEN 'skip'
            WHEN kind = 'credit' THEN 'lazada_credit' ELSE 'lazada_invoice' END AS layout
FROM invoice WHERE kind NOT IN ('spx', 'journal', 'ads')""",
    "supported": """
SELECT * FROM page WHERE layout <> 'skip' AND kind <> 'broken'""",
    "in_period": """
SELECT * FROM supported WHERE year(doc_date) = year AND month(doc_date) = month""",
    "purchases": f"""
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY {SOURCE}, year, month, CASE WHEN platform = 'Lazada' THEN doc_num ELSE doc_id END
                               ORDER BY upload_ord, doc_id) AS place FROM in_period) WHERE place = 1""",
}

NEEDS = {
    "lines": ["sales_rows"],
    "kept": ["lines"],
    "deduped": ["kept"],
    "order_day": ["deduped"],
    "daily": ["order_day"],
    "totals": ["daily"],
    "running": ["totals"],
    "orders_vat": ["deduped"],
    "sales": ["orders_vat"],
    "selection": ["sales_rows"],
    "manifest": ["sales_rows"],
    "periods": ["sales_rows"],
    "monthly": ["periods"],
    "fee_month": ["sales_rows"],
    "fee_doc": ["fee_month"],
    "invoice": ["fee_doc"],
    "page": ["invoice"],
    "supported": ["page"],
    "in_period": ["supported"],
    "purchases": ["in_period"],
}


def sql(statement: str, *tables: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in tables:
        add(name)
    if not wanted:
        return statement
    parts = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in wanted)
    return f"WITH {parts}\n{statement}"
