"""Texts and word lists for judging question and answer pairs."""
from __future__ import annotations

#: Sentences in each language, from which the language model starts.
SEEDS = {
    "en": """The device must check the signature before it accepts the message. If the value is not found, the process returns an error and the user is asked to try again.
    Each of these tables shows how the parameters are used and why they have been chosen by the authors. What is the difference between the two methods and where should they be used?
    There are many ways to write such a document, but most of them would not help the reader. After a few attempts the key is removed from the memory and cannot be read any more.
    It is recommended that the public part be stored with the others, as shown in the next section. Which of the following steps does this function require when it runs for the first time?
    This means that nothing else has changed, although the names are new. We both know that they were working on it, and that the results will be published this year.
    Give me the algorithm and define what it does. List the steps and the inputs, describe them and tell me how it is used, what it says about the rest and when.""",
    "de": """Das Gerät muss die Unterschrift prüfen, bevor es die Nachricht annimmt. Wird der Wert nicht gefunden, so gibt das Verfahren einen Fehler zurück und der Benutzer wird gebeten, es noch einmal zu versuchen.
    Jede dieser Tabellen zeigt, wie die Größen verwendet werden und warum sie von den Verfassern gewählt wurden. Was ist der Unterschied zwischen den beiden Wegen und wofür braucht man sie?
    Es gibt viele Möglichkeiten, ein solches Schreiben zu verfassen, aber die meisten würden dem Leser nicht helfen. Nach einigen Versuchen wird der Schlüssel aus dem Speicher gelöscht und kann nicht mehr gelesen werden.
    Es wird empfohlen, den öffentlichen Teil mit den anderen zu speichern, wie im nächsten Abschnitt gezeigt. Welche der folgenden Schritte sind nötig, sobald die Funktion zum ersten Mal läuft?
    Das heißt, dass sich sonst nichts geändert hat, obwohl die Namen neu sind. Die Gruppe um ihn hat daran gearbeitet, ohne dass etwas verändert wurde, und die Ergebnisse sollen dieses Jahr erscheinen.
    Gib mir den Algorithmus und erkläre, was er tut. Nenne die Schritte und die Eingaben, beschreibe sie und sag mir, wie man ihn benutzt, was er über den Rest sagt und wann.""",
    "fr": """L'appareil doit vérifier la signature avant d'accepter le message. Si la valeur est introuvable, le procédé renvoie une erreur et l'utilisateur est prié de recommencer.
    Chacun de ces tableaux montre comment les paramètres sont utilisés et pourquoi ils ont été choisis par les auteurs. Quelle est la différence entre les deux méthodes et où faut-il les employer?
    Il y a plusieurs façons d'écrire un tel document, mais la plupart n'aideraient pas le lecteur. Après quelques essais, la clé est effacée de la mémoire et ne peut plus être lue.
    Il est recommandé de conserver la partie publique avec les autres, comme on le voit dans la section suivante. Lesquelles de ces étapes sont nécessaires dès que la fonction est lancée pour la première fois?
    Cela veut dire que rien d'autre n'a changé, bien que les noms soient nouveaux. Son équipe y a travaillé sans modifier le reste, et les résultats seront publiés cette année.
    Donne-moi l'algorithme et explique ce qu'il fait. Cite les étapes et les entrées, décris-les et dis-moi comment on l'utilise, ce qu'il dit au sujet du reste et quand.""",
    "es": """El aparato debe comprobar la firma antes de aceptar el mensaje. Si no se encuentra el valor, el proceso devuelve un error y se pide al usuario que lo intente otra vez.
    Cada una de estas tablas muestra cómo se usan los parámetros y por qué los han elegido los autores. ¿Cuál es la diferencia entre los dos métodos y para qué sirven?
    Hay muchas maneras de escribir un documento así, pero la mayoría no ayudaría al lector. Tras unos intentos la clave se borra de la memoria y ya no se puede leer.
    Se recomienda guardar la parte pública con las demás, como se ve en la sección siguiente. ¿Qué pasos son necesarios en cuanto la función se ejecuta por primera vez?
    Esto quiere decir que nada más ha cambiado, aunque los nombres sean nuevos. El grupo trabajó en ello sin que cambiara el resto, mientras que los resultados quedarán para este año.
    Dame el algoritmo y explica lo que hace. Enumera los pasos y las entradas, descríbelos y dime cómo se usa, qué dice sobre el resto y cuándo.""",
    "it": """L'apparecchio deve verificare la firma prima di accettare il messaggio. Se il valore non viene trovato, il processo restituisce un errore e si chiede all'utente di riprovare.
    Ognuna di queste tabelle mostra come si usano i parametri e perché sono stati scelti dagli autori. Qual è la differenza tra i due metodi e dove si devono usare?
    Ci sono molti modi di scrivere un documento del genere, ma la maggior parte non aiuterebbe il lettore. Dopo alcuni tentativi la chiave viene cancellata dalla memoria e non può più essere letta.
    Si raccomanda di conservare la parte pubblica con le altre, come si vede nella sezione seguente. Quali di questi passi sono necessari appena la funzione viene eseguita per la prima volta?
    Ciò vuol dire che non è cambiato nient'altro, anche se i nomi sono nuovi. Il gruppo ci ha lavorato senza che il resto cambiasse, mentre gli esiti usciranno quest'anno; si veda anche l'allegato.
    Dammi l'algoritmo e spiega che cosa fa. Elenca i passi e gli ingressi, descrivili e dimmi come si usa, che cosa dice sul resto e quando.""",
    "pt": """O aparelho deve verificar a assinatura antes de aceitar a mensagem. Se o valor não for encontrado, o processo devolve um erro e pede-se ao utilizador que tente outra vez.
    Cada uma destas tabelas mostra como se usam os parâmetros e por que foram escolhidos pelos autores. Qual é a diferença entre os dois métodos e para que servem?
    Há muitas maneiras de escrever um documento assim, mas a maioria não ajudaria o leitor. Depois de algumas tentativas a chave é apagada da memória e já não pode ser lida.
    Recomenda-se guardar a parte pública com as outras, como se vê na secção seguinte. Quais destes passos são necessários quando a função é executada pela primeira vez?
    Isto quer dizer que nada mais mudou, embora os nomes sejam novos. O grupo trabalhou nisso sem que o resto mudasse, e os resultados serão publicados ainda este ano.
    Dá-me o algoritmo e explica o que faz. Enumera os passos e as entradas, descreve-os e diz-me como se usa, o que diz sobre o resto e quando.""",
    "nl": """Het apparaat moet de handtekening controleren voordat het de boodschap aanneemt. Als de waarde niet wordt gevonden, geeft het proces een fout terug en wordt de gebruiker gevraagd het nog eens te proberen.
    Elk van deze tabellen laat zien hoe de grootheden worden gebruikt en waarom de schrijvers ze hebben gekozen. Wat is het verschil tussen de twee wijzen en waarvoor zijn ze nodig?
    Er zijn veel manieren om zo'n stuk te schrijven, maar de meeste zouden de lezer niet helpen. Na een paar pogingen wordt de sleutel uit het geheugen gewist en kan hij niet meer worden gelezen.
    Het is aan te raden het openbare deel bij de andere te bewaren, zoals in het volgende hoofdstuk te zien is. Welke van deze stappen zijn nodig zodra de functie voor het eerst loopt?
    Dit betekent dat er verder niets is veranderd, hoewel de namen nieuw zijn. De groep heeft eraan gewerkt zonder dat de rest veranderde, en de uitkomsten verschijnen dit jaar.
    Geef mij het algoritme en leg uit wat het doet. Noem de stappen en de invoer, beschrijf ze en zeg mij hoe het wordt gebruikt, wat het over de rest zegt en wanneer.""",
}

#: What may stand before a question or an answer without belonging to it (patterns).
LABELS = [
    "answer", "final answer", "response", "question", "your question", "the question was", "you asked", "query", "q", "a",
    "antwort", "frage", "ihre frage", "sie fragten", "réponse", "reponse", "votre question", "respuesta", "pregunta", "tu pregunta", "risposta", "domanda",
]
LABELS = [rf"{x}(?=\s*[:=]|\s*\Z)" for x in LABELS]

#: Answers that say nothing (patterns).
PLACEHOLDERS = ["null", "none", "nil", "nan", "n\\s?/\\s?a", "na", "undefined", "unknown", "empty", "tbd", "todo", "no answer", "blank", "object object"]

#: Ways of declining in each language, one sentence a line, from which the model of refusals starts.
DECLINES = {
    "en": """I'm sorry, but I cannot answer that question.
I am afraid I can't help you with this.
I don't have enough information to give you an answer.
I do not know the answer to this question.
The text does not say anything about this.
This cannot be determined from the text that was given.
There is no mention of this in the material provided.
The sources do not cover this topic.
The question cannot be answered from the available documents.
Nothing in the supplied material addresses the question.
No answer is possible on the basis of these pages.
No comment.
I have no idea.
I would prefer not to answer.
I am not allowed to talk about this subject.
I am not able to provide any details about it.
I must refuse to respond to this request.
This is outside the scope of what I can discuss.
That falls outside the material I was given, so I can't say.
As an assistant I cannot comment on such matters.
The context doesn't contain the information that is needed.
I was unable to find anything relevant to your question.
We could not find any evidence for this in the documents.
It is not possible to tell from the passages.
Unfortunately I can't tell you more about this.
There is not enough evidence to answer.
Please ask someone else, since I don't have access to this.
I'd rather not speculate about that.
The documents are silent about it and I will not guess.
No answer is available.
Not found in the provided docs.
The information is not included in the excerpts.
My guidelines do not permit me to answer this.
That would go beyond my instructions.
Answering would go beyond what I was told to do.
The excerpts are silent on this.
The passages are silent on the matter, and a reply would be a guess.
Anything else would be pure guesswork.
I cannot provide details on it.
I can't give you details on that.
There is nothing in the context about it.
No relevant passage was found.
I won't speculate about it.
I won't speculate.
Therefore I won't give an answer.
There is nothing about that in the documents, so the question stays open.""",
    "de": """Es tut mir leid, aber diese Frage kann ich nicht beantworten.
Dazu kann ich leider nichts sagen.
Ich habe keine Informationen darüber.
Das weiß ich nicht.
Der Text sagt dazu nichts.
Die Frage lässt sich anhand der Unterlagen nicht beantworten.
In den Dokumenten wird das nicht erwähnt.
Dazu liegen mir keine Angaben vor.
Ich darf darüber keine Auskunft geben.
Dabei kann ich Ihnen nicht helfen.
Kein Kommentar.
Dazu möchte ich mich nicht äußern.
Aus den Quellen geht die Antwort nicht hervor.
Die vorliegenden Auszüge reichen für eine Antwort nicht aus.
Ich bin nicht in der Lage, darauf zu antworten.
Darüber will ich nicht spekulieren.
Das liegt außerhalb dessen, was ich beantworten darf.""",
    "fr": """Je suis désolé, mais je ne peux pas répondre à cette question.
Je ne sais pas.
Je n'ai pas d'informations à ce sujet.
Le texte ne dit rien à ce sujet.
Les documents ne permettent pas de répondre à la question.
Cette information ne figure pas dans les sources.
Je ne peux malheureusement pas vous aider.
Je préfère ne pas répondre.
Je ne suis pas autorisé à en parler.
Aucune réponse n'est possible à partir de ces extraits.
Sans commentaire.
Je ne suis pas en mesure de donner des détails.
Je n'ai rien trouvé sur ce point dans les passages.
Il m'est impossible de répondre à cette demande.
Cela dépasse ce que je peux dire.
Je ne veux pas spéculer là-dessus.
Je préfère ne pas me prononcer sur cette question.
Je ne souhaite pas me prononcer.""",
    "es": """Lo siento, pero no puedo responder a esa pregunta.
No lo sé.
No tengo información sobre este tema.
El texto no dice nada al respecto.
Los documentos no permiten contestar la pregunta.
Esa información no aparece en las fuentes.
Por desgracia no puedo ayudarle con esto.
Prefiero no responder.
No estoy autorizado a hablar de ello.
No es posible dar una respuesta a partir de estos pasajes.
Sin comentarios.
No soy capaz de dar detalles.
No he encontrado nada sobre este punto en los documentos.
Me es imposible contestar a esta solicitud.
Eso queda fuera de lo que puedo decir.
No quiero especular sobre eso.
No dispongo de datos sobre ello.
No dispongo de información para responder.""",
    "it": """Mi dispiace, ma non posso rispondere a questa domanda.
Non lo so.
Non ho informazioni su questo argomento.
Il testo non dice nulla in proposito.
I documenti non permettono di rispondere alla domanda.
Preferisco non rispondere.
Non sono autorizzato a parlarne.
Nessun commento.
Purtroppo non posso aiutarla.""",
}

#: Sentences of answers that hold words of refusals.
USUAL = """The answer is the second one. The answer is yes, since the document says so. The answer to this is given in the table. The question is answered in the next section. The information is stored in the header.
The text says that the value is found on the page. The documents cover both cases. The sources mention three of them. The passage contains the details. It is possible to provide another one. The context holds the key.
I have two of them. This was not possible before. You can find it in the document. There is no limit on the length. It cannot be changed later. It is not allowed to be empty. The request must be refused.
Die Antwort ist die zweite. Die Antwort steht in der Tabelle. Die Frage wird im nächsten Abschnitt beantwortet. Der Text nennt den Wert. Die Unterlagen enthalten beide Angaben. Das ist nicht erlaubt. Es kann nicht geändert werden.
La réponse est la deuxième. La réponse se trouve dans le tableau. Le texte donne la valeur. Les documents contiennent les deux informations. Il n'est pas possible de la changer. Ce n'est pas autorisé.
La respuesta es la segunda. La respuesta está en la tabla. El texto da el valor. Los documentos contienen la información. No es posible cambiarlo. No está permitido."""

#: Sentences around a refusal that say nothing themselves.
FILLERS = """Good question! Great question. Thank you for asking. Thanks for your patience. Let me be brief. Let me be clear. To be honest with you. In short. I have checked everything twice.
I read all the passages again. I searched all the documents. I looked at every page. Is there anything else? Can I help you with something else? Please let me know. Hello. Hi there. Unfortunately not.
Gute Frage! Danke für die Frage. Vielen Dank. Um es kurz zu machen. Kurz gesagt. Ehrlich gesagt. Ich habe alles zweimal geprüft. Ich habe alle Texte durchgesehen. Kann ich sonst noch helfen? Guten Tag.
Bonne question ! Merci de votre question. Merci beaucoup. Pour faire court. En bref. J'ai tout vérifié deux fois. J'ai relu tous les textes. J'ai tout relu deux fois. Puis-je vous aider autrement? Bonjour.
¡Buena pregunta! Gracias por preguntar. Muchas gracias. Para ser breve. En resumen. Lo he revisado todo dos veces. He leído todos los textos. ¿Puedo ayudarle en algo más? Hola.
Buona domanda! Grazie della domanda. In breve. Ho controllato tutto due volte. Posso aiutarla con altro? Buongiorno."""

#: Words after which a text goes on (without accents), in the languages of SEEDS.
NEVER_LAST = set(
    """
    the a an and or of to in on at by for from with without as if when while which whose that than whether because although unless until into onto upon between among through during
    is are was were be been has have had must shall should may might can could will would not no its their his her our your my this these those such both either neither each every any some
    following including namely e.g i.e only whereas so but nor
    der die das den dem des ein eine einen einem einer eines und oder von zu zum zur im am an auf aus bei bis durch fur gegen mit nach ohne um vor wie als wenn weil dass ob sobald bevor wahrend zwischen sowie sondern
    ist sind war wird werden muss mussen soll kann darf hat haben nicht kein keine seine ihre diese dieser dieses folgende folgenden beim vom ins
    le la les un une des du de et ou a au aux en dans par pour sur sous avec sans que qui dont si comme quand lorsque puis tandis parce afin dès des entre est sont etait doit doivent peut peuvent ne pas plus son sa ses leur leurs ce cet cette ces suivante suivants suivantes
    el los las una unos unas y o u del al en con por para sin sobre que cual cuyo si como cuando mientras porque aunque entre hasta desde es son era debe deben puede pueden no su sus este esta estos estas siguiente siguientes despues
    il lo gli i uno della dello dei degli delle dal dalla nel nella nello sul sulla con per tra fra che cui se come quando mentre perche finche e ed non deve devono puo possono sua suo questo questa seguente seguenti
    """.split()
)
