"""The queries the driver runs: name -> (spark, folder of tables) -> DataFrame, and the same in SQL."""
