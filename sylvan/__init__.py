"""A Spark-native engine for querying source trees and cleaning the tables made from them."""
