"""Files through the queue into tables: replays, faulty rows, retries, dead workers, restarts and waiting producers."""

import gzip
import json
from datetime import datetime, timedelta

import pytest

from marlstone.operators import queue, worker

T0 = datetime(2031, 2, 3, 4, 5, 6)
SECOND = timedelta(seconds=1)


def episode(key, **fields):
    """A row of title_episode as a message holds it."""
    return {"tconst": key, "parent_tconst": f"series of {str(key)[0]}"} | fields


def message(*rows, table="title_episode"):
    return json.dumps({"table": table, "rows": list(rows)})


@pytest.fixture
def shop(spark, tmp_path):
    """A queue, a table's folder and a folder of dead letters."""

    class Shop:
        store = queue.StoredQueue(spark, str(tmp_path / "queue"))
        tables, dead = {"title_episode": str(tmp_path / "episodes")}, str(tmp_path / "dead")

        def send(self, *payloads):
            first = (self.store.table().count() or 0) + 1
            return self.store.apply(queue.enqueue_many, "line", list(payloads), T0, first)

        def drain(self, now=T0, **options):
            return worker.drain(spark, self.store, "line", self.tables, self.dead, now, **options)

        def held(self):
            return {r.tconst: r for r in spark.read.parquet(self.tables["title_episode"]).collect()}

        def stats(self):
            return queue.queue_stats(self.store.table(), "line").first().asDict()

    return Shop()


def said(inserted, skipped, bad):
    return {"table_name": "title_episode", "inserted": inserted, "skipped": skipped, "bad": bad}


def test_what_is_sent_twice_lands_once(spark, shop):
    one = json.dumps({"table": "title_episode", "data": episode("a1", season_number=4, metadata={"seen": [1, 2]})})
    many = message(*[episode(f"b{k}", episode_number=k) for k in range(6)], episode("b0", episode_number=77))
    shop.send(one, many)
    assert shop.drain() == [said(7, 1, 0)]
    got = shop.held()
    assert len(got) == 7 and got["a1"].season_number == 4 and json.loads(got["a1"].metadata) == {"seen": [1, 2]} and got["b0"].episode_number == 0 and got["b5"].season_number is None
    shop.send(many, one)
    assert shop.drain() == [said(0, 8, 0)] and shop.held() == got
    stats = worker.ingest_stats(spark, shop.tables, T0).first()
    assert stats.row_count == 7 and stats.total_bytes > 0


def test_faulty_rows_and_messages(spark, shop):
    shop.send(message(episode("a1"), episode("a2", season_number=3_000_000_000), episode("a3")), message(episode(None)), "[]", message(episode("a4"), table="unheard_of"), message(episode("a5", episode_number="five")))
    shop.drain(max_attempts=2)
    assert set(shop.held()) == {"a1", "a3"}
    assert {(r.sqlstate, r.error) for r in spark.read.parquet(shop.dead).collect()} == {("22003", "season_number"), ("23502", "tconst"), ("22P02", "episode_number")}
    assert shop.stats() == {"pending": 0, "processing": 0, "done": 1, "failed": 4, "total": 5}
    assert {r.attempts for r in shop.store.table().filter("status = 'failed'").collect()} == {2}


def test_what_a_dead_worker_held_is_done_by_the_next(spark, shop):
    """It died before the insert with one message and after it with another."""
    shop.send(message(episode("a1")), message(episode("a2")))
    shop.store.apply(queue.dequeue, "line", T0, 1, 30 * SECOND)
    assert shop.drain() == [said(1, 0, 0)] and set(shop.held()) == {"a2"}
    shop.send(message(episode("a2", season_number=9)))
    shop.store.apply(queue.dequeue, "line", T0, 1, 30 * SECOND)
    assert shop.drain(T0 + 30 * SECOND) == [] and shop.stats()["processing"] == 2
    assert shop.drain(T0 + 31 * SECOND) == [said(1, 1, 0)] and set(shop.held()) == {"a1", "a2"}
    assert shop.stats()["done"] == 3 and shop.store.table().filter("attempts = 1").count() == 2


def test_a_lease_that_always_runs_out_fails_at_last(shop):
    shop.send(message(episode("a1")))
    now, tries = T0, 0
    while shop.stats()["failed"] == 0:
        shop.store.apply(queue.dequeue, "line", now, 1, SECOND)
        now, tries = now + 2 * SECOND, tries + 1
        shop.store.apply(queue.reap_expired, "line", now, 3)
    assert tries == 3 and shop.store.table().first().last_error == queue.EXPIRED


def ratings_file(folder, n, extra=""):
    path = folder / "title.ratings.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("tconst\taverageRating\tnumVotes\n" + "".join(f"t{k:04d}\t7.{k % 10}\t{k}\n" for k in range(n)) + extra)
    return str(path)


def test_produce_goes_on_where_it_stopped(spark, shop, tmp_path):
    path = ratings_file(tmp_path, 25)
    waits = []

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        worker.produce(spark, shop.store, "line", "title_ratings", path, T0, size=4, step_lines=10, high=3, low=0, wait=die)
    stored = worker.last_progress(shop.store, "title_ratings")
    assert (stored.lines_read, stored.completed) == (10, False) and stored.messages == shop.stats()["pending"] >= 3
    assert worker.produce(spark, shop.store, "line", "title_ratings", path, T0, size=4, step_lines=10, high=3, low=0) == stored

    def wait():
        waits.append(shop.stats()["pending"])
        taken = shop.store.apply(queue.dequeue, "line", T0, 100)
        shop.store.apply(queue.ack, spark.createDataFrame([(r.msg_id,) for r in taken], "id long"), T0)

    done = worker.produce(spark, shop.store, "line", "title_ratings", path, T0, size=4, step_lines=10, high=3, low=0, wait=wait)
    assert done.completed and done.lines_read == 25 and len(waits) == 2 and done == worker.last_progress(shop.store, "title_ratings")
    keys = [x["tconst"] for r in shop.store.table().orderBy("id").collect() for x in json.loads(r.payload)["rows"]]
    assert keys == [f"t{k:04d}" for k in range(25)]
    assert worker.produce(spark, shop.store, "line", "title_ratings", path, T0) == done
    ratings_file(tmp_path, 25, "t9999\t1.0\t1\n")
    with pytest.raises(ValueError):
        worker.produce(spark, shop.store, "line", "title_ratings", path, T0)


def test_messages_keep_the_order_of_rows(spark, shop, tmp_path):
    path = ratings_file(tmp_path, 300)
    worker.produce(spark, shop.store, "line", "title_ratings", path, T0, size=1)
    rows = shop.store.table().orderBy("id").collect()
    assert [json.loads(r.payload)["rows"][0]["tconst"] for r in rows] == [f"t{k:04d}" for k in range(300)] and [r.id for r in rows] == list(range(1, 301))
