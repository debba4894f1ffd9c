"""Column -> Column functions. Figures, names and keys stay in the JVM; periods are read in Arrow batches."""
