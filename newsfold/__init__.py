"""newsfold: build, describe, split, classify and evaluate news headlines on Spark."""
