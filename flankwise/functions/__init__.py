"""Column -> Column expression library. Everything here stays on the JVM."""
