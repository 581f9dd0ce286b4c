import pytest

from zonecast.session import session


@pytest.fixture(scope="session")
def spark():
    out = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="3g", spark_ui_enabled="false")
    out.sparkContext.setLogLevel("ERROR")
    return out
