"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Packet inputs are
derived and stored once before the clock starts, as a capture would be.
"""

from __future__ import annotations

import json
import os
import sys
import time


from namestrata.operators import domain_filter, headers, messages, reports, rollups, rows, sampling
from namestrata.operators.reassembly import reassemble_fragments, tcp_messages
from namestrata.plans import traffic
from namestrata.plans.capture import packets_to_results
from namestrata.plans.queries import ALLOW_LINES, AS_OF, SKIP_LINES
from namestrata.session import cut_lineage, get_session, shared_dir
from namestrata.sinks.tables import write_log
from namestrata.sources import protobuf
from namestrata.sources.domain_lists import domain_list_from


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    log = traffic.dns_log(spark, sf_dir)
    parts = int(cpus) * 2

    def stored(df, name):
        return cut_lineage(df.repartition(parts), name)

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = stored(events, "events")
    results = cut_lineage(traffic.results_of(events), "results")
    packets = cut_lineage(traffic.udp_packets_of(events), "packets")
    frames = cut_lineage(traffic.dnstap_frames_of(events), "frames")
    fragments = cut_lineage(traffic.fragment_packets_of(events), "fragments")
    segments = cut_lineage(traffic.tcp_packets_of(events), "tcp")
    skip, allow = domain_list_from(spark, SKIP_LINES), domain_list_from(spark, ALLOW_LINES)
    domain_count = rollups.rollup(log, "domain_count")

    def udp(df):
        fields = headers.on_port(headers.transport(headers.ip_datagrams(df).filter("error IS NULL")))
        return messages.udp_records(fields, 24, 64)

    bench = {
        **{f"rollup_{name}": (lambda n=name: rollups.rollup(log, n)) for name in rollups.ROLLUPS},
        "timeline": lambda: reports.request_timeline(log),
        "new_domains": lambda: reports.new_domains(log, AS_OF, 2),
        "top_domains": lambda: reports.top_domains(domain_count, 20),
        "skip_and_allow": lambda: domain_filter.filter_domains(log, 4, skip, allow),
        "sample_packets": lambda: sampling.sample_records(log, "2:7"),
        "drop_copies": lambda: sampling.drop_copies(packets, 60),
        "ingest_udp_packets": lambda: udp(packets),
        "ingest_dnstap": lambda: protobuf.dnstap_results(frames),
        "ingest_log_rows": lambda: rows.dns_log_rows(results),
        "reassemble_fragments": lambda: reassemble_fragments(headers.ip_datagrams(fragments)),
        "tcp_messages": lambda: tcp_messages(headers.transport(headers.ip_datagrams(segments))),
        "packets_to_results": lambda: packets_to_results(packets, dedup_seconds=60),
    }
    sizes = {"ingest_udp_packets": packets.count(), "ingest_dnstap": frames.count()}
    spark.range(1000).selectExpr("sum(id)").collect()
    taken = {}
    for name, build in bench.items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        taken[name] = round(min(runs), 3)
    start = time.perf_counter()
    write_log(log, shared_dir(spark, "bench-log"))
    taken["write_log"] = round(time.perf_counter() - start, 3)
    rates = {n: round(count / taken[n]) for n, count in sizes.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
                "queries": taken, "rows_per_second": rates, "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
