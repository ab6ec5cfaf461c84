"""Command line: offline verbs over a working folder.

    python -m tallyspark.cli VERB [--work DIR] ARGUMENTS

download URL ENTRY FILE | ingest FILE | build SOURCE_SHA | report RELEASE | plan | version | profile RELEASE OBSERVATION |
samples RELEASE | train RELEASE | evaluate MODEL | score RELEASE OBSERVATION MODEL | expire FOLDER DAYS | generate COUNT FILE | produce COUNT SERVERS TOPIC
"""

from __future__ import annotations

import argparse
import json
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import functions as F

from .config import ExperimentPlan, GenerationSettings, ProfileBatch, ScoreBatch
from .operators import customers, snapshots
from .plans import experiment, publication, serving
from .plans.folder import Folder
from .schema import SHEET
from .session import local_session
from .sources import events, generator, workbook
from .streaming.pipeline import code_version

ARGUMENTS = {
    "download": ["url", "entry", "file"], "ingest": ["file"], "build": ["source"], "report": ["release"], "plan": [], "version": [], "profile": ["release", "observation"], "samples": ["release"], "train": ["release"], "evaluate": ["model"], "score": ["release", "observation", "model"], "expire": ["folder", "days"],
    "generate": ["count", "file"], "produce": ["count", "servers", "topic"],
}
DATASET = "retail"
DEFAULT_PLAN = ExperimentPlan(training=(date(2011, 6, 1), date(2011, 7, 1)), validation=(date(2011, 8, 1),), test=(date(2011, 9, 1), date(2011, 10, 1)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--work", default="work", help="a folder, or the URI of one on a shared filesystem")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in ARGUMENTS.items():
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
    return p


def _coverage(facts) -> tuple[date, date]:
    row = facts.agg(F.min("invoice_time"), F.max("invoice_time")).first()
    return date.fromisoformat(row[0][:10]), date.fromisoformat(row[1][:10])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(code_version())
        return 0
    if a.verb == "plan":
        print(json.dumps(DEFAULT_PLAN.__dict__, default=str, indent=1))
        return 0
    if a.verb == "download":
        print(workbook.download(a.url, a.entry, Path(a.file)))
        return 0
    if a.verb == "generate":
        sent = {"sent": 0, "duplicates": 0, "out_of_order": 0}
        with Path(a.file).open("w") as out:
            for g in generator.generate(GenerationSettings(count=int(a.count))):
                out.write(f"{g.event.to_json()}\n")
                for name, one in zip(sent, (True, g.duplicate, g.late), strict=True):
                    sent[name] += one
        print(json.dumps(sent))
        return 0
    spark = local_session()
    work = Folder.of(spark, a.work if "://" in a.work else Path(a.work))
    if a.verb in ("report", "evaluate"):
        folder, name = (work / "releases" / a.release, "quality.json") if a.verb == "report" else (work / "models" / a.model, "evaluation.json")
        publication.verify(folder)
        print((folder / name).read())
    elif a.verb == "produce":
        rows = generator.generated(spark, GenerationSettings(count=int(a.count)))
        events.write_kafka(rows, a.servers, a.topic)
        print(rows.count())
    elif a.verb == "expire":
        print(snapshots.expire_stored(spark, a.folder, datetime.now(timezone.utc).replace(tzinfo=None), int(a.days)))
    elif a.verb == "ingest":
        source = Path(a.file)
        sha = publication.file_digest(source)

        def fill(part: Folder) -> dict:
            # an executor reads the copy in the working folder (a sheet is one task) and writes the landing
            (part / source.name).fetch(source)
            workbook.write_landing(workbook.stored_workbook(spark, str(part / source.name)), f"{part}/landing")
            return {"source": source.name, "sha256": sha, "sheet": SHEET, "rows": workbook.read_landing(spark, f"{part}/landing").count()}

        publication.publish_folder(work / "raw" / sha, fill)
        print(sha)
    elif a.verb == "build":
        manifest = publication.verify(work / "raw" / a.source)
        raw = workbook.read_landing(spark, f"{work}/raw/{a.source}/landing")
        print(publication.build_release(raw, work / "releases", a.source, manifest["rows"]))
    else:
        facts = publication.release_table(spark, work / "releases", a.release, "facts")
        service = serving.CustomerService(spark, work / "customers")
        if a.verb == "samples":
            rows = customers.all_samples(facts, DEFAULT_PLAN, *_coverage(facts))
            for r in customers.label_counts(rows).collect():
                print(*r)
        elif a.verb == "train":
            print(experiment.train(facts, DEFAULT_PLAN, _coverage(facts), work / "models", a.release, code_version()))
        else:
            observation = date.fromisoformat(a.observation)
            days = DEFAULT_PLAN.history_days
            rows = customers.profiles(customers.features(facts, observation, days))
            batch = ProfileBatch(publication.identity("profile", a.release, observation, days, code_version()), DATASET, a.release, code_version(), observation, days)
            service.publish_profiles(batch, rows)
            if a.verb == "score":
                manifest = publication.verify(work / "models" / a.model)
                experiment.compatible(manifest, a.release, days, observation, code_version())
                stored = service.profiles.rows(DATASET, batch.id)
                scores = experiment.score(spark, work / "models", a.model, stored)
                service.publish_scores(DATASET, ScoreBatch(publication.identity("score", batch.id, a.model), batch.id, a.model, manifest["candidate"], manifest["horizon_days"]), scores)
            print(batch.id, "until", observation - timedelta(days=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
