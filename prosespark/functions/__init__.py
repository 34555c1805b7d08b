"""Column functions: text, atoms and fixed values. All are built-in expressions that stay in the JVM."""
