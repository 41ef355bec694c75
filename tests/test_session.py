from fourthtick.session import DEFAULTS, build_session


def test_chosen_settings_win_and_the_rest_is_filled_in(spark):
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "64m")
    try:
        built = build_session()
        assert built.conf.get(key) == "64m"
        other = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        assert built.conf.get(other) == DEFAULTS[other]
    finally:
        spark.conf.unset(key)
