"""framelake: DataFrame operators for compressed-video analytics and the data around it."""
