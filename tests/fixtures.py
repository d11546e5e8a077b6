"""Small schemas with known joins."""

RETAIL = {
    "stores": ("store_id int pk, store_name string, city string, region_id int fk", [(1, "Main", "Pune", 10), (2, "North", "Delhi", 20)]),
    "regions": ("region_id int pk, region_code string, region_name string", [(10, "W", "West"), (20, "N", "North")]),
    "products": ("product_id int pk, product_name string, category_id int fk, unit_cost decimal", [(501, "Pen", 1, 1.5), (502, "Book", 2, 7.25)]),
    "categories": ("category_id int pk, category_code string, category_name string", [(1, "ST", "Stationery"), (2, "BK", "Books")]),
    "customers": ("customer_id int pk, first_name string, last_name string, email string, signup_date date", [(100, "Asha", "Rao", "asha@x.org", "2023-01-05"), (101, "Ben", "Li", "ben@y.org", "2024-02-11")]),
    "orders": ("order_id int pk, customer_id int fk, store_id int fk, order_date date, status_code string", [(9001, 100, 1, "2024-03-01", "SHIPPED"), (9002, 101, 2, "2024-04-02", "OPEN")]),
    "order_lines": ("line_id int pk, order_id int fk, product_id int fk, quantity int, unit_price decimal", [(1, 9001, 501, 2, 1.5), (2, 9002, 502, 1, 7.25)]),
}
RETAIL_EDGES = {
    ("regions.region_id", "stores.region_id"), ("categories.category_id", "products.category_id"), ("customers.customer_id", "orders.customer_id"),
    ("orders.store_id", "stores.store_id"), ("order_lines.order_id", "orders.order_id"), ("order_lines.product_id", "products.product_id"),
}


def json_tables(schema: dict) -> list[dict]:
    out = []
    for name, (columns, rows) in schema.items():
        parts = [c.split() for c in columns.split(", ")]
        declared = [{"name": p[0], "type": p[1], "is_pk": "pk" in p[2:], "is_fk": "fk" in p[2:], "nullable": "pk" not in p[2:]} for p in parts]
        out.append({"name": name, "columns": declared, "sample_data": [dict(zip((p[0] for p in parts), r)) for r in rows]})
    return out
