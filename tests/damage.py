"""Copies of the test tables that are empty, full of nulls, or have repeated rows and columns with the operators' own names."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = ["modifications", "schema_entries", "import_jobs", "sink_runs", "documents", "doc_labels", "bench_items", "mix_targets", "common_words"]
OWN = """
row_key ts is_change alive after_key before_key row both key_columns key_type bucket batch last was now n1 n2 n3 b segment is_large is_carried _carried state chain pos kind until
set unset valid_from valid_to attributes misfits rules placed print columns columns_before lsn_text pending taken low high bin first offset record_key namespace_ n known copies
let_through looked_up is_new is_repeat _least _copy _at is_late words share size docs item tokens block pass shard place limit upto available quota shape h count probability n_ _salt
""".split()


def damaged(source, folder, how, seed=1):
    """A folder with the tables of ``source`` after ``how``: "empty", "nulls" or "clashes"."""
    rng = random.Random(seed)
    os.makedirs(folder, exist_ok=True)
    for name in TABLES:
        t = pq.read_table(f"{source}/{name}.parquet")
        if how == "empty":
            t = t.slice(0, 0)
        elif how == "nulls":
            t = pa.table({c: pa.array([None if rng.random() < 0.15 else v for v in t[c].to_pylist()], t.schema.field(c).type) for c in t.column_names})
            t = pa.concat_tables([t, t.slice(0, 50), pa.table({c: pa.nulls(3, t.schema.field(c).type) for c in t.column_names})])
        else:
            for c in OWN:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * t.num_rows))
        pq.write_table(t, f"{folder}/{name}.parquet")
    return folder
