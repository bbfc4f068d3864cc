from datetime import date

from pyspark.sql import functions as F

from paceline.operators import dates, weather


def test_places_share_a_cell_to_three_decimals(spark):
    df = spark.createDataFrame([(40.41678, -3.70379), (40.4168, -3.7038), (40.4, -3.7)], "lat double, lon double")
    assert [r[0] for r in df.select(weather.cell(F.col("lat"), F.col("lon"))).collect()] == ["40.417:-3.704", "40.417:-3.704", "40.400:-3.700"]


def test_windows_are_clamped_and_never_turned_round():
    as_of = date(2024, 5, 31)
    assert dates.window("week", as_of) == (date(2024, 5, 27), as_of)
    assert dates.window("last3m", as_of)[0] == date(2024, 3, 2)  # the 31st of February runs over
    assert dates.window("alltime", as_of, date(2020, 1, 1), low=date(2021, 1, 1)) == (date(2021, 1, 1), as_of)
    assert dates.window("last7", as_of, high=date(2024, 1, 1)) == (date(2024, 1, 1), date(2024, 1, 1))
    assert dates.window("year", as_of, custom=(date(2000, 1, 1), date(2000, 2, 1))) == (date(2000, 1, 1), date(2000, 2, 1))
