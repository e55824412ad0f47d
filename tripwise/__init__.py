"""Haulage-event analytics on Spark: motion signals, plates, trips, reports, ingest and maintenance."""


def ship(spark) -> None:
    """Sends this package to the executors: needed where it is not installed on them and the driver runs outside the repository."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", here.parent, here.name))
